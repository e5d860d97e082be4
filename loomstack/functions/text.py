"""Text analysis: the two tokenizer stages as Column builders, and their Python twins for queries and for whole texts.

Stage 1 turns a text into an ordered list of distinct tokens: qualified names, words, their camel and snake pieces, and pairs of
neighbouring CJK characters. Stage 2 splits and folds these once more; a query token of several stage-2 terms is a phrase.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
NOT_WORD = rf"[^\p{{L}}\p{{Nd}}_{CJK}]+"
QUALIFIED = r"[\p{L}_][\p{L}\p{Nd}_]*(?:(?:::|\.)[\p{L}_][\p{L}\p{Nd}_]*)+"
CAMEL = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})"
NOT_TERM = r"[^\p{L}\p{N}\p{Co}]+"

#: Latin letters with diacritics and the letters they fold to, derived from their decompositions.
_FOLDS = {chr(c): d[0] for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()}
ACCENTED, PLAIN = "".join(_FOLDS), "".join(_FOLDS.values())


def _nonempty(a: Column) -> Column:
    return F.filter(a, lambda x: x != "")


def _camel(p: Column) -> Column:
    return F.when(p.rlike(CAMEL), F.split(p, CAMEL)).otherwise(F.array().cast("array<string>"))


def _pieces(p: Column) -> Column:
    snake = F.flatten(F.transform(_nonempty(F.split(p, "_")), lambda q: F.concat(F.array(q), _camel(q))))
    return F.when(F.instr(p, "_") > 0, snake).otherwise(_camel(p))


def _pairs(p: Column) -> Column:
    return F.when(F.length(p) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def runs(c: Column) -> Column:
    """Words of a text; a run changes where the script turns to or from CJK."""
    plain = _nonempty(F.split(c, NOT_WORD))
    mixed = F.flatten(F.transform(plain, lambda w: F.regexp_extract_all(w, F.lit(rf"[{CJK}]+|[^{CJK}]+"), F.lit(0))))
    return F.when(c.rlike(f"[{CJK}]"), mixed).otherwise(plain)


def _qualified(c: Column, query: bool) -> Column:
    chains = F.regexp_extract_all(c, F.lit(QUALIFIED), F.lit(0))

    def spell(chain: Column) -> Column:
        parts = F.split(chain, r"::|\.")
        prefixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.slice(parts, F.lit(1), n))
        if query:
            return F.transform(prefixes, lambda p: F.array_join(p, ""))
        return F.flatten(F.transform(prefixes, lambda p: F.array(F.array_join(p, "::"), F.array_join(p, ""), F.array_join(p, "."))))

    none = F.array().cast("array<string>")
    return F.when(c.rlike(QUALIFIED), F.flatten(F.transform(chains, spell))).otherwise(none)


def tokens(c: Column, query: bool = False) -> Column:
    """Stage 1: ordered distinct tokens. A query keeps only the joined spelling of qualified names, and only the pairs of long CJK runs."""
    c = F.coalesce(c, F.lit(""))

    def spell(p: Column) -> Column:
        cjk = p.rlike(f"[{CJK}]")
        word = F.when(cjk & (F.length(p) > 2), F.array().cast("array<string>")).otherwise(F.array(p)) if query else F.array(p)
        return F.when(cjk, F.concat(word, _pairs(p))).when(p.rlike(f"_|{CAMEL}"), F.concat(word, _pieces(p))).otherwise(word)

    return F.array_distinct(F.transform(F.concat(_qualified(c, query), F.flatten(F.transform(runs(c), spell))), lambda t: F.lower(t)))


def terms(stage1: Column) -> Column:
    """Stage 2: each token split at what is no letter or number, in lower case and without Latin diacritics; order and repeats kept."""
    fold = lambda t: F.when(t.rlike("[À-ɏ]"), F.translate(t, ACCENTED, PLAIN)).otherwise(t)
    return F.flatten(F.transform(stage1, lambda t: _nonempty(F.split(fold(F.lower(t)), NOT_TERM))))


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def path_terms(path: Column) -> Column:
    """Tokens of a path: directories, name and extension."""
    return tokens(F.translate(slashes(path), "/.-", "   "))


def basename(path: Column) -> Column:
    return F.regexp_extract(slashes(path), r"([^/]*)/*$", 1)


def basename_terms(path: Column) -> Column:
    """Tokens of the file name: stem and extension apart."""
    return tokens(F.regexp_replace(basename(path), r"^(.*)\.([^.]*)$", "$1 $2"))


# ---- Python twins -----------------------------------------------------------------------------------------------------------
def _is_cjk(ch: str) -> bool:
    import regex

    return regex.match(r"[\p{Han}\p{Hiragana}\p{Katakana}]", ch) is not None


def py_tokens(text: str, query: bool = True) -> list[str]:
    """Stage 1 in Python."""
    import regex

    out: dict[str, None] = {}
    for m in regex.finditer(QUALIFIED, text):
        parts = regex.split(r"::|\.", m.group())
        for n in range(2, len(parts) + 1):
            for t in ([] if query else ["::".join(parts[:n])]) + ["".join(parts[:n])] + ([] if query else [".".join(parts[:n])]):
                out[t.lower()] = None
    for word in regex.findall(r"[\p{L}\p{Nd}_\p{Han}\p{Hiragana}\p{Katakana}]+", text):
        for run in regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}]+|[^\p{Han}\p{Hiragana}\p{Katakana}]+", word):
            if _is_cjk(run[0]):
                if not query or len(run) <= 2:
                    out[run.lower()] = None
                for i in range(len(run) - 1):
                    out[run[i:i + 2]] = None
                continue
            out[run.lower()] = None
            for piece in [q for q in run.split("_") if q] if "_" in run else [run]:
                parts = [p for p in regex.split(CAMEL, piece, flags=regex.V1) if p]
                for t in ([piece] if "_" in run else []) + (parts if len(parts) > 1 else []):
                    out[t.lower()] = None
    return [t for t in out if t]


def py_terms(token: str) -> list[str]:
    """Stage 2 in Python."""
    import regex

    return [t for t in regex.split(NOT_TERM, token.lower().translate(str.maketrans(ACCENTED, PLAIN))) if t]


def query_phrases(query: str) -> list[list[str]]:
    """Phrases of a query; a token without any term gives an empty phrase, which nothing matches."""
    return [py_terms(t) for t in py_tokens(query)]


class Analyzer:
    """Both stages for whole texts. Words repeat, so the pieces of a word and the terms of a token are looked up, within CACHE entries."""

    CACHE = 200_000

    def __init__(self, query: bool = False):
        import regex

        self.query, self.words, self.folded = query, {}, {}
        self.chains = regex.compile(QUALIFIED)
        self.runs = regex.compile(r"[\p{L}\p{Nd}_\p{Han}\p{Hiragana}\p{Katakana}]+")
        # On ASCII the standard library's classes are the same sets, and faster.
        self.ascii_chains = re.compile(r"[A-Za-z_]\w*(?:(?:::|\.)[A-Za-z_]\w*)+", re.A)
        self.ascii_runs = re.compile(r"\w+", re.A)

    def tokens(self, text: str | None) -> list[str]:
        if not text:
            return []
        plain = text.isascii()
        out: dict[str, None] = {}
        for chain in (self.ascii_chains if plain else self.chains).findall(text):
            parts = re.split(r"::|\.", chain.lower())
            for n in range(2, len(parts) + 1):
                if not self.query:
                    out["::".join(parts[:n])] = None
                out["".join(parts[:n])] = None
                if not self.query:
                    out[".".join(parts[:n])] = None
        words = self.words
        for w in (self.ascii_runs if plain else self.runs).findall(text):
            pieces = words.get(w)
            if pieces is None:
                if len(words) > self.CACHE:
                    words.clear()
                pieces = words[w] = dict.fromkeys(py_tokens(w, self.query))
            out |= pieces
        return list(out)

    def terms(self, text: str | None) -> list[str]:
        out: list[str] = []
        folded = self.folded
        for t in self.tokens(text):
            f = folded.get(t)
            if f is None:
                if len(folded) > self.CACHE:
                    folded.clear()
                f = folded[t] = [t] if t.isascii() and t.isalnum() else py_terms(t)
            out += f
        return out


_analyzers: dict[bool, Analyzer] = {}


def _analyzer(query: bool) -> Analyzer:
    """One per process."""
    if query not in _analyzers:
        _analyzers[query] = Analyzer(query)
    return _analyzers[query]


@F.arrow_udf(ArrayType(StringType()))
def _text_tokens(texts: pa.Array) -> pa.Array:
    a = _analyzer(False)
    return pa.array([a.tokens(t) for t in texts.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(ArrayType(StringType()))
def _text_terms(texts: pa.Array) -> pa.Array:
    a = _analyzer(False)
    return pa.array([a.terms(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def text_tokens(c: Column) -> Column:
    """Stage 1 of whole texts. Higher-order functions are interpreted per word; with words looked up, an Arrow batch is ten times as fast."""
    return _text_tokens(c)


def text_terms(c: Column) -> Column:
    """Both stages of whole texts."""
    return _text_terms(c)


# Words that lead a definition.
LEAD_WORDS = frozenset("class_name class func function def type struct interface signal const var method fn".split())


def symbol_token(query: str) -> str | None:
    """The identifier that a query asks for: a bare or qualified name, or such a name behind one lead word."""
    import regex

    name = regex.compile(r"(?=[^\p{L}\p{Nd}_]*[\p{L}\p{Nd}_])[\p{L}\p{Nd}_.:/]+")
    q = query.strip()
    if q and name.fullmatch(q):
        return q
    parts = q.split()
    return parts[1] if len(parts) == 2 and parts[0].lower() in LEAD_WORDS and name.fullmatch(parts[1]) else None
