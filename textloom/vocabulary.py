"""Fixed values of the text operators: word lists, lookup tables, patterns and thresholds.

Everything in this module is data that results depend on; it is stated plainly and can be replaced by parameters.
"""

from __future__ import annotations

# Noise terms by category, in the order in which categories are tested.
WATERMARKS = ["oceanofpdf", "ebscohost", "packt", "oreilly", "manning", "springer", "wiley", "apress", "pearson", "allitebooks", "foxebook", "pdfhive", "bookzz", "libgen"]
MORE_WATERMARKS = ["safari", "books", "online", "downloaded"]
URL_FRAGMENTS = ["www", "http", "https", "com", "org", "net", "edu", "gov", "html", "htm", "php", "asp"]
GENERIC_FILLER = [
    "using", "used", "use", "one", "two", "three", "new", "first", "second", "third", "example", "examples", "also", "many", "much", "well", "way",
    "need", "make", "see", "get", "set", "can", "may", "like", "just", "even", "know", "take", "come", "want", "look", "give",
]
CODE_ARTIFACTS = [
    "self", "cls", "none", "true", "false", "return", "import", "from", "class", "def", "if", "else", "elif", "for", "while", "try", "except",
    "finally", "with", "as", "lambda", "yield", "pass", "break", "continue", "raise", "assert", "global", "nonlocal", "del",
]
PAGE_MARKERS = [
    "chapter", "section", "figure", "table", "page", "appendix", "index", "contents", "bibliography", "references", "glossary", "preface",
    "introduction", "conclusion", "summary", "abstract", "acknowledgments",
]
NOISE_CATEGORIES = {"watermarks": WATERMARKS, "url_fragments": URL_FRAGMENTS, "generic_filler": GENERIC_FILLER, "code_artifacts": CODE_ARTIFACTS, "page_markers": PAGE_MARKERS}

# Suffix rules (suffix, replacement, least length of what is left), longest first, and words never stemmed.
SUFFIX_RULES = [("ation", "", 5), ("ity", "", 4), ("ing", "", 4), ("ies", "y", 3), ("es", "", 3), ("s", "", 4)]
PROTECTED_TERMS = [
    "microservices", "kubernetes", "serverless", "apis", "graphql", "rest", "grpc", "redis", "postgres", "mongodb", "pytorch", "tensorflow", "keras",
    "javascript", "typescript", "fastapi", "numpy", "pandas",
]

# What marks a concept as an author's name or as noise.
AUTHOR_PATTERNS = ["(?i)Copyright", "©", r"^[A-Z][a-z]+\s+[A-Z]\.\s+[A-Z][a-z]+$", r"(?i)All\s+Rights\s+Reserved"]
KNOWN_AUTHORS = [
    "ousterhout", "john", "fowler", "martin", "gamma", "helm", "johnson", "vlissides", "knuth", "stroustrup", "kernighan", "ritchie", "bloch",
    "meyers", "sutter", "alexandrescu", "kleppmann", "nygard", "newman",
]
CONCEPT_NOISE = [
    "taking", "little", "people", "things", "way", "time", "part", "bring", "kind", "sure", "long", "high", "low", "good", "bad", "big", "small",
    "names", "john", "much", "many", "well", "even", "just", "also", "using", "used", "use", "make", "made", "get", "got", "set", "put", "come",
    "came", "go", "went", "take", "took", "give", "gave",
]
GENERIC_TERMS = [
    "data", "split", "value", "item", "list", "string", "number", "function", "method", "class", "object", "variable", "code", "file", "result",
    "output", "input", "return", "type", "name", "get", "set", "add", "remove", "create", "update", "delete", "process", "handle",
]
GRAPH_GENERIC_TERMS = ["split", "data", "the", "a", "an", "is", "are", "get", "set"]
TECHNICAL_PARTS = ["_", "-", "api", "http", "json", "xml", "sql", "ml", "ai", "llm", "gpu", "cpu"]
SIMPLE_STOPWORDS = ["the", "a", "an", "is", "are", "with", "for", "and", "or", "in", "on"]

# Keywords in a title that give its domain, tested in this order.
TITLE_DOMAINS = {
    "ai-ml": ["ai", "llm", "machine learning", "deep learning", "neural", "transformer", "embedding", "rag", "nlp", "python", "architecture patterns"],
    "systems": ["c++", "concurrency", "systems programming", "memory", "operating system", "kernel", "low-level"],
}

# Parents of keywords, and children of parents; they are not each other's inverse.
PARENTS = {
    "attention": "transformer", "embedding": "vector", "langchain": "llm", "llamaindex": "llm", "fastapi": "python", "flask": "python",
    "django": "python", "kubernetes": "container", "docker": "container",
}
CHILDREN = {
    "transformer": ["attention", "encoder", "decoder"], "vector": ["embedding", "index"], "llm": ["langchain", "llamaindex", "openai", "anthropic"],
    "python": ["fastapi", "flask", "django", "pydantic"], "container": ["kubernetes", "docker"],
}

# Diagrams.
FIGURE = r"(?i)^\s*(figure\s+[\d.]+)\s*[:\-]?\s*(.*)$"
DIAGRAM = r"(?i)^\s*(diagram\s+[\d.]+)\s*[:\-]?\s*(.*)$"
ARCHITECTURE = r"(?i)^\s*(architecture\s+diagram)\s*[:\-]?\s*(.*)$"
BOX_CHARACTERS = "─│┌┐└┘├┤┬┴┼═║╔╗╚╝╠╣╦╩╬+-|"
ART_DENSITY = 0.05

# Lines of a book index, tried in this order.
INDEX_LINES = [
    r"^(.+?)\s{2,}(\d[\d,\s\-–n]+)$",
    r"^([^,]+),\s*(\d[\d,\s\-–n]+)$",
    r"^([a-zA-Z][\w\s()\-]+?)\s+(\d{1,4}(?:[\s,\-–n]+\d{1,4})*)$",
    r"^(.+?)\s+(\d{1,4}(?:[\s,\-–n]+\d{1,4})*)$",
]

# The domains that terms are compared with.
CODE_PARTS = ["def ", "class ", "import ", "from ", "()", "->", "=>", "function ", "const ", "let ", "var "]

# Thresholds and weights of the composite quality of an extraction.
QUALITY = {"min_text": 100, "max_text": 10_000, "min_keywords": 3, "max_keywords": 20, "min_concepts": 1, "max_concepts": 10}
QUALITY_WEIGHTS = {"keywords": 0.3, "concepts": 0.3, "domain": 0.2, "length": 0.2}
