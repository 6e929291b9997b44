"""Quality rules, line first: lines that fail a rule go, then documents that lose too much text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Phrases of boilerplate lines by language; a text may mix languages, so all given ones are looked for in every line.
BOILERPLATE = {
    "any": r"©|\(c\) ?(19|20)\d\d|lorem ipsum|spdx-license",
    "en": r"released under the \w+ licen[cs]e|licensed under|all rights reserved|terms of (use|service)|privacy policy|accept (all )?cookies|uses cookies|enable javascript"
    r"|click here|sign up|log ?in to|subscribe to|share (this|on)|follow us|powered by|copyright \(c\)",
    "fr": r"tous droits réservés|mentions légales|conditions (générales|d'utilisation)|politique de confidentialité|accepter (tous )?les cookies|utilise des cookies|activer javascript"
    r"|cliquez ici|inscrivez-vous|connectez-vous|abonnez-vous|partager sur|suivez-nous|propulsé par|sous licence",
    "de": r"alle rechte vorbehalten|impressum|nutzungsbedingungen|datenschutz(erklärung|hinweise)|(alle )?cookies akzeptieren|verwendet cookies|javascript aktivieren"
    r"|klicken sie hier|hier klicken|jetzt registrieren|anmelden|abonnieren sie|teilen auf|folgen sie uns|unter der \w+[- ]lizenz",
    "es": r"todos los derechos reservados|aviso legal|(términos|condiciones) de (uso|servicio)|política de privacidad|aceptar (todas )?las cookies|utiliza cookies|activar javascript"
    r"|haga clic aquí|regístrese|inicie sesión|suscríbase|compartir en|síganos|bajo la licencia",
}
NAVIGATION = re.compile(r"\s(?:\||»|›|·|•|>)(?=\s|$)")
WINDOW = 5
#: Parts of a pattern: alternatives (a group is one part); groups, classes, escapes and letters that a match may lack; what stands between literals.
ALTERNATIVE = re.compile(r"(?:\\.|\((?:[^()\\]|\\.)*\)|\[[^\]]*\]|[^|(\[\\])+")
OPTIONAL = re.compile(r"(?:\((?:[^()\\]|\\.)*\)|\[[^\]]*\]|\\.|[^\\])(?:[?*]|\{[^}]*\})|\((?:[^()\\]|\\.)*\)|\[[^\]]*\]|\\.|[.^$]")
SIGN = re.compile(r"\\([!-/:-@\[-`{-~])")
LITERAL = re.compile(r"[\x00+]")
#: Letters that match i when case is ignored, but don't fold to it.
DOTTED = {0x130: "i", 0x131: "i"}


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that occur twice or more in the text, first ones included."""
    if len(words) <= WINDOW:
        return 0
    seen = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(seen)) == len(seen):
        return 0
    counts = Counter(seen)
    covered, upto = 0, 0
    for i, window in enumerate(seen):
        if counts[window] > 1:
            covered += i + WINDOW - max(i, upto)
            upto = i + WINDOW
    return covered


@dataclass(frozen=True)
class Rules:
    """A line fails with more than one symbol for `symbols` characters, one navigation sign for `signs` words, one exclamation or question mark for `marks` words (two are free), `shouted` words in capitals alone, `letterless` words without any letter, or a phrase of boilerplate within `phrase` words. A document fails when it loses more than `lost` of its words."""

    symbols: int = 10
    signs: int = 5
    marks: int = 3
    shouted: int = 8
    letterless: int = 4
    phrase: int = 40
    lost: float = 0.5
    boilerplate: tuple[str, ...] = tuple(BOILERPLATE.values())

    @cached_property
    def phrases(self) -> re.Pattern | None:
        return re.compile("|".join(self.boilerplate), re.I) if self.boilerplate else None

    @cached_property
    def seeds(self) -> tuple[str, ...]:
        """Of each phrase letters that every match has, case folded; none at all if a phrase has no such letters."""
        held = SIGN.sub(lambda m: chr(0xE000 + ord(m[1])), "|".join(self.boilerplate))  # signs behind a backslash are letters as others
        found = [max(LITERAL.split(OPTIONAL.sub("\0", x)), key=len) for x in ALTERNATIVE.findall(held)]
        found = ["".join(chr(ord(c) - 0xE000) if 0xE000 <= ord(c) < 0xE080 else c for c in x) for x in found]
        return tuple(dict.fromkeys(x.casefold() for x in found)) if all(found) else ()

    def has_phrase(self, line: str) -> bool:
        if not self.phrases:
            return False
        if self.seeds:
            low = (line if line.isascii() else line.translate(DOTTED)).casefold()
            if not any(x in low for x in self.seeds):
                return False
        return self.phrases.search(line) is not None


def line_fails(line: str, words: list[bytes], rules: Rules = Rules()) -> str:
    """The rule that a line with words fails, or the empty string."""
    letters = len(line) - line.count(" ")
    if sum(line.count(c) for c in SYMBOLS) * rules.symbols > letters:
        return "navigation" if line.count("|") * 3 > len(words) else "symbols"
    if len(NAVIGATION.findall(line)) * rules.signs > len(words):
        return "navigation"
    if (line.count("!") + line.count("?")) > max(2, len(words) // rules.marks):
        return "punctuation"
    if len(words) >= rules.shouted and line.isupper():
        return "punctuation"
    if len(words) >= rules.letterless and not any(c.isalpha() for c in line):
        return "punctuation"
    if len(words) <= rules.phrase and rules.has_phrase(line):
        return "boilerplate"
    return ""


def judge(text: str, rules: Rules) -> tuple:
    """The row of one text, without its id; the last value is the cleaned text."""
    words = text.encode().split()
    n_words = len(words)
    repeats = repeated_words(words)
    lines = text.split("\n")
    seen: set[str] = set()
    duplicates = with_words = removed = lost = 0
    kept_lines = []
    for line in lines:
        own = line.encode().split()
        if not own:
            kept_lines.append(line)
            continue
        with_words += 1
        if line in seen:
            duplicates += 1
        else:
            seen.add(line)
        if line_fails(line, own, rules):
            removed += 1
            lost += len(own)
        else:
            kept_lines.append(line)
    base_failed = n_words < 10 or 100 * repeats > 20 * n_words
    share = lost / n_words if n_words else 0.0
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    return n_words, chars, sum(text.count(c) for c in SYMBOLS), duplicates, repeats, base_failed, not base_failed and share <= rules.lost, with_words, removed, min(1.0, share), "\n".join(kept_lines)


COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_lines_removed long, lost double"
)


def clean(docs: DataFrame, rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """One row a document: doc_id, counts, base_failed, kept, lost (share of words in removed lines), and clean_text if asked for.

    Rows are worked on by themselves: no shuffle, one text at a time in memory. Texts are judged whole. A null text is
    an empty one and fails the base rules; lines without words are neither judged nor counted; repeated rows give a row
    each; other columns are ignored, an empty table gives an empty result.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [(n, types[c.split()[1]]) for n, c in zip(names, COLUMNS.split(", "), strict=True)]

    def run(batches):
        for batch in batches:
            rows = [judge(t.as_py() or "", rules) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(len(fields) + 1)]
            arrays = [batch.column(0)] + [pa.array(x, t) for x, (_, t) in zip(columns, fields, strict=False)]
            if with_text:
                arrays.append(pa.array(columns[-1], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names] + ["clean_text"] * with_text)

    schema = f"doc_id long, {COLUMNS}" + ", clean_text string" * with_text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
