"""Problem 5: live credentials in source code and configuration, exactly as they stand.

1. *Index.* One pass proposes literals: values assigned to credential-like names, passwords inside URLs, values behind an
   authorization scheme, private key blocks, vendor token formats, and values that a comment calls old or due for rotation.
2. *Suppress.* Values that have the form of a placeholder or reference are refused at once. Owners (files) are counted over the corpus: a
   literal of more than SHARED_FILES files, whatever the size of the corpus, is under suspicion of being a placeholder or an example.
3. *Confirm.* A rare literal is confirmed by what proposed it, a structure of its own or a credential-like name. A widely shared one is
   confirmed only if nobody would make it up: random looking, free of the words of examples, and if it has no structure of its own, long.
4. *Re-scan.* Every chunk is searched again for confirmed secrets, wherever they stand. The set of secrets grows with the corpus,
   so it is not broadcast: words of the chunks meet the words of the secrets in a join (a bitmap of fixed size keeps back the words of no
   secret), the rarest word of each secret over all chunks is its anchor, and one Aho-Corasick automaton for each batch of
   rows, over the secrets that met them, decides on their texts. Secrets without a word of WORD characters are anchored by a few of their
   characters in a row. What a chunk proposed stays found in it.

Defined results: null and empty bodies give nothing; a secret that stands several times in a chunk is reported once; a private
key that the chunk's window cuts is no whole literal and not reported, but redaction puts the windows of a file together and blanks the
parts of such a key in all of them; repeated chunk ids count as one chunk; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstack.runtime import table, written

#: Least characters of an anchor word; characters in a row that anchor a secret without one, the first number that it is long enough for.
WORD, GRAMS = 3, (4, 2, 1)
#: Bits of the bitmaps over words and anchors, as powers of two: 2 MB and 128 KB.
WORD_BITS, BITS = 24, 20
#: A literal in more files than this is widely shared.
SHARED_FILES = 8

# ---- names ------------------------------------------------------------------------------------------------------------------
# Words that make a name a credential, and last words that make it something about one.
CREDENTIAL_WORDS = frozenset("password passwd pwd pass passphrase passcode passwort kennwort secret secrets token credential credentials auth pw authorization apikey accesskey secretkey".split())
RUN_TOGETHER = ("password", "passwd", "passphrase", "passwort", "pass", "secret", "token", "credential", "apikey", "accesskey", "secretkey", "signingkey", "hmackey", "sessionkey")
KEY_OWNERS = frozenset("api access secret private signing session hmac encryption crypto salt account shared master auth service deploy webhook client storage ssh".split())
ABOUT_WORDS = frozenset("hash count length len policy type id ids url uri path file name names expiry ttl min max limit size format field header hint label env ref tokens ratio version regex pattern algorithm alg method mode provider enabled required page form".split())
#: What every credential-like name ends with, digits aside.
ENDINGS = tuple(sorted({*CREDENTIAL_WORDS, *RUN_TOGETHER, "key", "passe"}))
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def is_credential_name(name: str) -> bool:
    words = [w.lower() for w in _WORDS.findall(name.rpartition(".")[2])]
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in ABOUT_WORDS or "public" in words:
        return False
    if words[-1] in CREDENTIAL_WORDS or words[-3:] == ["mot", "de", "passe"] or (words[-1].endswith(RUN_TOGETHER) and words[-1] not in ("bypass", "compass", "trespass")):
        return True
    return words[-1] == "key" and any(w in KEY_OWNERS for w in words[:-1])


# ---- values -----------------------------------------------------------------------------------------------------------------
PLACEHOLDER = re.compile(
    r"""^(?:$|<[^<>]*>$|\$\{|\$\(|\$[A-Z_]+$|\{\{|%\(|%[A-Z_]+%$|\#\{|env:|vault:|file:|ref:|secret:|arn:|op://|ssm:|sops:|ENC\[|
    \*+$|(.)\1*$|(?:x|X|\.|-|_)+$|(?i:replace|change|your|insert|enter|put|todo|fixme|example|dummy|sample|placeholder|redacted|none$|null$|nil$|true$|false$|undefined$|process\.env|os\.environ|env\[|getenv|
    test$|secret$|password$|passwd$|token$|default$|string$|required$|optional$|bearer$|basic$|strict$|n/a$))""", re.X)
HASHED = re.compile(r"^\$(?:2[abxy]|argon2\w*|5|6|1|apr1|scrypt|pbkdf2\S*)\$|^(?:sha\d+|md5|blake\w*)[-:]", re.I)
VENDOR = re.compile(
    r"(?<![A-Za-z0-9_\-])(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{20,}|glpat-[\w\-]{20}|(?:AKIA|ASIA)[A-Z0-9]{16}|xox[abeoprs]-[A-Za-z0-9\-]{10,}|npm_[A-Za-z0-9]{30,}|"
    r"AIza[\w\-]{35}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-(?:proj-|ant-)?[A-Za-z0-9_\-]{20,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{40,}|pypi-[\w\-]{40,}|"
    r"eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{8,}|[a-z]{2,8}_(?:live|prod|test|secret)_[A-Za-z0-9]{20,})(?![A-Za-z0-9_])")
PRIVATE_KEY = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----[\s\S]*?-----END \1PRIVATE KEY-----")
SCHEME = re.compile(r"^(Bearer|Basic|Token|ApiKey|Api-Key|Digest|Negotiate|Key)[ \t]+(\S+)$", re.I)
URL_LOGIN = re.compile(r"://([^\s/:@\"'`<>]*):([^\s\"'`]+?)@(?=[A-Za-z0-9\[])")
_GIVEN = r"""[ \t]*\]?[ \t]*(?::[ \t]*[A-Za-z]+[ \t]*=|:=|\|\|=|\?\?=|=>|==?|:|,|["'][ \t]+value=)[ \t]*(["'`])"""
#: Behind the last word of a name: the quoted value that it is given.
QUOTED = re.compile(rf"""\d*["'`]?{_GIVEN}([^"'`\r\n]*+)\1""")
SCHEMED = re.compile(rf"""[\w"'`\]]{_GIVEN}((?i:Bearer|Basic|Token|ApiKey|Api-Key|Digest|Negotiate|Key)[ \t]+[^"'`\r\n]*+)\1""")
BARE = re.compile(r"^[ \t]*(?:export[ \t]+|set[ \t]+|-[ \t]+|ENV[ \t]+)?([A-Za-z_][\w.\-]*)[ \t]*[=:][ \t]*([^\s\"'`{}\[\](),;<>#][^\r\n\"'`]*?)[ \t]*(?:[ \t]#[^\r\n]*)?\r?$", re.M)
ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]*)>([^<>\r\n]+)</\1>")
NAMED = re.compile(r"""["']?name["']?[ \t]*[:=][ \t]*["']?([A-Za-z_][\w.\-]*)["']?[ \t]*,?\s+["']?value["']?[ \t]*[:=][ \t]*(?:(["'`])([^"'`\r\n]*)\2|([^\s"'`]+))""")
KEYED = re.compile(r"""\b(?:key|name|id)=(["'])([A-Za-z_][\w.\-]*)\1[ \t]+value=(["'])([^"'\r\n]*)\3""")
HEADER = re.compile(r"""(?:-H|--header)[ \t=]*["']([A-Za-z][\w\-]*):[ \t]*([^"'\r\n]+)["']""")
LOGIN_CALL = re.compile(r"""\b(?:login|log_in|sign_in|signin|authenticate|basic_auth|set_credentials)\(\s*(["'`])[^"'`\r\n]*\1\s*,\s*(["'`])([^"'`\r\n]+)\2""", re.I)
OPTION = re.compile(r"""--([a-z][a-z\-]*)(?:=|[ \t]+)(["']?)([^\s"']+)\2""")
LOGIN_OPTION = re.compile(r"""(?:^|[\s])(?:-u|--user)[ \t=]+["']?[\w.\-]+:([^\s"'@]+)""")
REMARK = re.compile(r"(?:#|//|--|;|/\*|<!--|\*)[^\r\n]*?\b(?:old (?:one|key|token|password|secret) (?:was|is)|rotate|revoke|expires?|leaked|(?:password|token|secret|key) (?:was|is))[: \t]+[\"'`]?([^\s\"'`]{8,})")
_PATHLIKE = re.compile(r"^(?:\.{0,2}/)?[\w.\-]+(?:/[\w.\-]+)+$")


def entropy(s: str) -> float:
    """Bits per character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _secret_look(v: str) -> bool:
    """The look of a secret rather than of a word, number, path or piece of code."""
    if len(v) < 6 or v.isdigit() or re.search(r"\s", v):
        return False
    if re.search(r"[()\[\]{}]|::|->|=>", v) and re.match(r"[A-Za-z_][\w.]*[(\[{]", v):
        return False
    if v.startswith("/") and _PATHLIKE.match(v) and not re.search(r"\d", v):
        return False
    return bool(re.search(r"\d|[^\w]|[a-z][A-Z]", v)) or entropy(v) > 3.2


def _unwrapped(value: str, named: bool) -> str | None:
    """The bare secret inside an assigned value, or None."""
    m = SCHEME.match(value)
    if m:
        inner = m.group(2)
        if PLACEHOLDER.match(inner) or HASHED.match(inner):
            return None
        if m.group(1).lower() == "basic":
            try:
                return inner if b":" in base64.b64decode(inner + "=" * (-len(inner) % 4)) else None
            except ValueError:
                return None
        return inner if _secret_look(inner) else None
    if "://" in value or not named or PLACEHOLDER.match(value) or HASHED.match(value):
        return None
    return value if _secret_look(value) else None


_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: In lower case, one of each group stands in every text in which the expression finds something.
_SCHEMES = ("bearer", "basic", "token", "apikey", "api-key", "digest", "negotiate", "key")
_LOGINS = ("login(", "log_in(", "sign_in(", "signin(", "authenticate(", "basic_auth(", "set_credentials(")
_VENDORS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "akia", "asia", "xox", "npm_", "aiza", "sk_", "rk_", "sk-", "sg.", "hf_", "dop_v1_", "pypi-", "eyj", "_live_", "_prod_", "_test_", "_secret_")
_REMARKS = ("old ", "rotate", "revoke", "expire", "leaked", " is", " was")
_endings = None


def _named_values(body: str, low: str) -> list[tuple[str, str]]:
    """(name, quoted value) wherever a name that ends like a credential is given one; an automaton finds the endings."""
    global _endings
    if _endings is None:
        import ahocorasick

        _endings = ahocorasick.Automaton()
        for w in ENDINGS:
            _endings.add_word(w, None)
        _endings.make_automaton()
    out = []
    for end, _ in _endings.iter(low):
        m = QUOTED.match(body, end + 1)
        if m:
            a = end
            while a and (body[a - 1] in _NAME or body[a - 1].isalnum()):
                a -= 1
            out.append((body[a:end + 1], m.group(2)))
    return out


#: Words that only an example holds, and runs of letters of one case, which random values have few of.
_EXAMPLE = re.compile(r"(?i)example|sample|dummy|fake|change|your|test|demo|placeholder|1234|abcd|qwer|secret|passw|foobar")
_RUN = re.compile(r"[a-z]{4,}|[A-Z]{4,}|(.)\1{2,}")


def unguessable(v: str, structured: bool) -> bool:
    """Would nobody make this value up? A structure of its own (a format, a key block) stands for length."""
    if v.startswith("-----BEGIN "):
        return True
    loose = sum(len(m.group()) for m in _RUN.finditer(v))
    return (structured or len(v) >= 12) and not _EXAMPLE.search(v) and entropy(v) >= 2.8 and loose * 2 <= len(v) and re.search(r"\d", v) is not None


def propose(body: str | None) -> set[tuple[str, bool]]:
    """(literal, structured) pairs of one chunk. Structured values stand for themselves, others need their name."""
    if not body:
        return set()
    low = body.lower()
    if len(low) != len(body):
        low = body.translate(_LOWER)
    out: set[tuple[str, bool]] = set()
    if "-----BEGIN" in body:
        out |= {(m.group(), True) for m in PRIVATE_KEY.finditer(body)}
    assigned = _named_values(body, low)
    assigned += [(m.group(1), m.group(2)) for m in BARE.finditer(body)]
    if any(w in low for w in _SCHEMES):
        assigned += [("", m.group(2)) for m in SCHEMED.finditer(body)]
    if "</" in body:
        assigned += [(m.group(1), m.group(2)) for m in ELEMENT.finditer(body)]
    if "value=" in body:
        assigned += [(m.group(2), m.group(4)) for m in KEYED.finditer(body)]
    if "-H" in body or "--header" in body:
        assigned += [("auth" if "private" in m.group(1).lower() else m.group(1), m.group(2)) for m in HEADER.finditer(body)]
    if any(w in low for w in _LOGINS):
        assigned += [("password", m.group(3)) for m in LOGIN_CALL.finditer(body)]
    if "value" in body and "name" in body:
        assigned += [(m.group(1), m.group(3) if m.group(3) is not None else m.group(4)) for m in NAMED.finditer(body)]
    if "--" in body:
        assigned += [(m.group(1), m.group(3)) for m in OPTION.finditer(body)]
    for name, value in assigned:
        v = _unwrapped(value.strip(), is_credential_name(name))
        if v:
            out.add((v, VENDOR.fullmatch(v) is not None or SCHEME.match(value.strip()) is not None))
    if "://" in body:
        out |= {(m.group(2), True) for m in URL_LOGIN.finditer(body) if m.start() and body[m.start() - 1] in _NAME and not PLACEHOLDER.match(m.group(2))}
    if any(w in low for w in _VENDORS):
        out |= {(m.group(), True) for m in VENDOR.finditer(body)}
    if "-u" in body:
        out |= {(m.group(1), False) for m in LOGIN_OPTION.finditer(body) if not PLACEHOLDER.match(m.group(1))}
    if any(w in low for w in _REMARKS):
        for m in REMARK.finditer(body):
            v = m.group(1).rstrip(".,;:")
            if not PLACEHOLDER.match(v) and not HASHED.match(v) and "://" not in v and re.search(r"\d", v) and _secret_look(v):
                out.add((v, False))
    return out


PROPOSED = "chunk_id long, file_id long, literal string, strong boolean"


def literals(chunks: DataFrame) -> DataFrame:
    """The corpus-wide index: (chunk_id, file_id, literal, strong), ``strong`` telling a value that nobody would make up."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, f, v, unguessable(v, s)) for c, f, b in zip(*(batch.column(n).to_pylist() for n in ("id", "file_id", "raw_body"))) for v, s in sorted(propose(b))]
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.bool_()))], ["chunk_id", "file_id", "literal", "strong"])

    return chunks.where("raw_body is not null").select("id", "file_id", "raw_body").mapInArrow(scan, PROPOSED)


def confirmed(index: DataFrame) -> DataFrame:
    """(literal) of the index that are rare, or widely shared and yet nothing that one would make up.

    Owners are counted in two steps, (literal, file) pairs first, so that a placeholder in a third of all files is no hot key.
    """
    pairs = index.groupBy("literal", "file_id").agg(F.max("strong").alias("strong"))
    owners = pairs.groupBy("literal").agg(F.count("*").alias("owners"), F.max("strong").alias("strong"))
    return owners.where((F.col("owners") <= SHARED_FILES) | F.col("strong")).select("literal")


def _grams(text: str, n: int) -> np.ndarray:
    """A number for each ``n`` characters in a row of ``text``."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = np.zeros(max(len(c) - n + 1, 0), np.uint64)
    for k in range(n):
        h = (h ^ c[k:k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _anchor(v: str) -> tuple[int, int]:
    """(characters, number) that anchor a secret without a word: of its characters in a row those with the most different ones."""
    n = next(n for n in GRAMS if len(v) >= n)
    at = max(range(len(v) - n + 1), key=lambda i: len(set(v[i:i + n])))
    return n, int(_grams(v[at:at + n], n)[0])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("literal").to_pylist()
        sizes, grams = zip(*map(_anchor, values)) if values else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column("literal"), pa.array(sizes, pa.int32()), pa.array(grams, pa.int64())], ["literal", "n", "gram"])


def _gram_meets(chunks: DataFrame, odd: DataFrame) -> DataFrame:
    """(id, literal) of chunks and the secrets without a word whose anchor they hold; some hold only a part that is numbered alike."""
    anchors = written(odd.mapInArrow(_anchors, "literal string, n int, gram long"), "grams")
    buckets = anchors.select("n", F.expr(f"gram & {2 ** BITS - 1}").alias("bit")).distinct().toArrow()  # at most 2^BITS for each of GRAMS
    bitmaps = {}
    for n in set(buckets["n"].to_pylist()):
        bitmaps[n] = np.zeros(2 ** BITS, bool)
        bitmaps[n][buckets.filter(pa.compute.equal(buckets["n"], n))["bit"].to_numpy()] = True
    sent = chunks.sparkSession.sparkContext.broadcast({n: np.packbits(m) for n, m in bitmaps.items()})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = {n: np.unpackbits(m).astype(bool) for n, m in sent.value.items()}
        for batch in batches:
            ids, sizes, grams = [], [], []
            for chunk, body in zip(batch.column("id").to_pylist(), batch.column("raw_body").to_pylist()):
                for n, m in maps.items():
                    g = _grams(body, n)
                    g = np.unique(g[m[g & (2 ** BITS - 1)]])
                    ids += [chunk] * len(g)
                    sizes += [n] * len(g)
                    grams += g.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(grams, pa.int64())], ["id", "n", "gram"])

    held = chunks.where("raw_body is not null").select("id", "raw_body").mapInArrow(scan, "id long, n int, gram long")
    return held.join(anchors, ["n", "gram"]).select("id", "literal")


#: ASCII letters and digits, by byte.
_ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of the words of at least WORD ASCII letters and digits in a column of texts, straight from its bytes."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]] if len(column) else np.zeros(0, np.uint8)
    inside = _ALNUM[data]
    inside_next = np.append(inside, False)
    cut = np.zeros(len(data) + 1, bool)
    cut[ends - ends[0] if len(ends) else 0] = True  # no word goes from one text to the next
    begins = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | cut[:-1]))
    stops = np.flatnonzero(inside & (~inside_next[1:] | cut[1:])) + 1
    keep = stops - begins >= WORD
    begins, stops = begins[keep], stops[keep]
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        # Sums of bytes times powers of an odd number; taking the power of the word's start away again is a product with its inverse.
        power = np.cumprod(np.full(int(data.size), np.uint64(_ODD)))
        total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
        h = (total[stops] - total[begins]) * np.cumprod(np.full(int(data.size), np.uint64(_INVERSE)))[begins]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) + (stops - begins).astype(np.uint64)
    return np.searchsorted(ends - ends[0], begins, side="right") - 1, h.view(np.int64)


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _secret_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, h = _word_hashes(batch.column("literal"))
        yield pa.RecordBatch.from_arrays([batch.column("literal").take(pa.array(row)), pa.array(h)], ["literal", "word"])


def _word_meets(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """(id, literal) of chunks and the secrets whose rarest word they hold. ``words``: (literal, word)."""
    spark = chunks.sparkSession
    bits = words.select(F.expr(f"word & {2 ** WORD_BITS - 1}").alias("bit")).distinct().toArrow()["bit"].to_numpy()  # at most 2^WORD_BITS
    bitmap = np.zeros(2 ** WORD_BITS, bool)
    bitmap[bits] = True
    sent = spark.sparkContext.broadcast(np.packbits(bitmap))  # fixed size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(sent.value).astype(bool)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                row, h = _word_hashes(batch.column("raw_body"))
                on = known[h & (2 ** WORD_BITS - 1)]
                got = pa.table({"id": batch.column("id").take(pa.array(row[on])), "word": pa.array(h[on])}).group_by(["id", "word"]).aggregate([])
                yield from got.select(["id", "word"]).to_batches() or [pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["id", "word"])]

    held = written(chunks.where("raw_body is not null").select("id", "raw_body").mapInArrow(scan, "id long, word long"), "held")
    seen = held.groupBy("word").agg(F.count("*").alias("n"))
    anchors = words.join(seen, "word").groupBy("literal").agg(F.min(F.struct("n", "word")).alias("s")).select("literal", "s.word")
    return held.join(anchors, "word").select("id", "literal")


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    for batch in batches:
        ids, found = [], []
        auto = ahocorasick.Automaton()
        for v in {v for secrets in batch.column("secrets").to_pylist() for v in secrets}:
            auto.add_word(v, v)
        if len(auto):
            auto.make_automaton()
            for chunk, body in zip(batch.column("id").to_pylist(), batch.column("raw_body").to_pylist()):
                seen = set()
                for end, v in auto.iter(body):
                    a, b = end - len(v) + 1, end + 1
                    if v not in seen and not (a and body[a - 1].isalnum() and v[0].isalnum()) and not (b < len(body) and body[b].isalnum() and v[-1].isalnum()):
                        seen.add(v)
                ids += [chunk] * len(seen)
                found += sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["chunk_id", "secret"])


def rescan(chunks: DataFrame, secrets: DataFrame) -> DataFrame:
    """(chunk_id, secret) for every chunk in which a confirmed secret stands as a whole."""
    words = written(secrets.mapInArrow(_secret_words, "literal string, word long").distinct(), "words")
    meets = _word_meets(chunks, words)
    odd = secrets.join(words.select("literal").distinct(), "literal", "left_anti")
    if not odd.isEmpty():
        meets = meets.unionByName(_gram_meets(chunks, odd))
    meets = meets.groupBy("id").agg(F.collect_set("literal").alias("secrets"))  # bounded by the chunk's own words
    return chunks.where("raw_body is not null").select("id", "raw_body").join(meets, "id").mapInArrow(_hits, "chunk_id long, secret string")


def secrets(chunks: DataFrame) -> DataFrame:
    """(chunk_id, secret): index, suppress, confirm and re-scan."""
    index = written(literals(chunks), "literals")
    sure = written(confirmed(index), "secrets")
    proposed = index.join(sure, "literal", "left_semi").select("chunk_id", F.col("literal").alias("secret"))
    return rescan(chunks, sure).unionByName(proposed).distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "chunks", "id", "file_id", "raw_body"))


def blanked(body: str, values: list[str]) -> str:
    """``body`` with each secret replaced by as many stars; line ends inside a key stay, so lines and columns keep their places."""
    for v in sorted(set(values), key=len, reverse=True):
        body = body.replace(v, re.sub(r"[^\r\n]", "*", v))
    return body


# ---- keys that windows cut --------------------------------------------------------------------------------------------------
_MARK = re.compile(r"-----(BEGIN|END) (?:[A-Z0-9]+ )*PRIVATE KEY-----")
_KEY_LINE = re.compile(r"[ \t]*(?:[A-Za-z0-9+/=]{16,}|[A-Za-z0-9+/]*={0,2}|[A-Za-z\-]+: .*)[ \t\\\"'`,;+n]*\r?")
MIDDLE, HEAD, TAIL = 1, 2, 4


def key_part(body: str | None) -> int:
    """What a window may hold of a key that it does not hold whole: HEAD its end, TAIL its beginning, MIDDLE nothing but key lines."""
    if not body:
        return 0
    marks = [m.group(1) for m in _MARK.finditer(body)]
    if not marks:
        return MIDDLE if all(_KEY_LINE.fullmatch(x) for x in body.split("\n")) and body.strip() else 0
    return (HEAD if marks[0] == "END" else 0) | (TAIL if marks[-1] == "BEGIN" else 0)


def blank_parts(body: str, parts: int) -> str:
    """``body`` with the given parts of cut keys blanked."""
    stars = lambda text: re.sub(r"[^\r\n]", "*", text)
    if parts & MIDDLE:
        return stars(body)
    marks = list(_MARK.finditer(body))
    if parts & TAIL and marks:
        body = body[:marks[-1].start()] + stars(body[marks[-1].start():])
    if parts & HEAD and marks:
        body = stars(body[:marks[0].end()]) + body[marks[0].end():]
    return body


def cut_keys(chunks: DataFrame) -> DataFrame:
    """(id, parts) of the windows that hold a part of a private key. ``chunks``: id, file_id, start_line, end_line, raw_body.

    Ends and beginnings stand for themselves; a window of key lines alone counts if the window before it, line for line, leaves a key open.
    Only windows with such parts are put in order, so a file of any size costs its few windows with keys.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = np.array([key_part(b) for b in batch.column("raw_body").to_pylist()], np.int32)
            at = pa.array(np.flatnonzero(parts))
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in ("id", "file_id", "start_line", "end_line")), pa.array(parts).take(at)], ["id", "file_id", "start_line", "end_line", "parts"])

    some = chunks.where("raw_body is not null").select("id", "file_id", *[F.col(c).cast("long").alias(c) for c in ("start_line", "end_line")], "raw_body").mapInArrow(
        scan, "id long, file_id long, start_line long, end_line long, parts int")
    w = Window.partitionBy("file_id").orderBy("start_line", "end_line", "id")
    # A run of windows that follow each other without a gap; a key is open in it after a beginning.
    some = some.withColumn("gap", F.coalesce((F.col("start_line") > F.lag("end_line").over(w) + 1).cast("int"), F.lit(1))).withColumn("run", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("file_id", "run").orderBy("start_line", "end_line", "id").rowsBetween(Window.unboundedPreceding, -1)
    marked = F.when(F.col("parts") != MIDDLE, F.col("parts").bitwiseAND(TAIL))
    some = some.withColumn("open", F.coalesce(F.last(marked, ignorenulls=True).over(before), F.lit(0)) > 0)
    return some.where((F.col("parts") != MIDDLE) | F.col("open")).select("id", "parts")


def redacted(chunks: DataFrame) -> DataFrame:
    """(id, raw_body) of all chunks, secrets blanked in place, parts of cut keys too where the windows' lines are known."""
    per = secrets(chunks).groupBy(F.col("chunk_id").alias("id")).agg(F.collect_set("secret").alias("secrets"))
    found = per.withColumn("parts", F.lit(0))
    if {"start_line", "end_line"} <= set(chunks.columns):
        cut = cut_keys(chunks).groupBy("id").agg(F.max("parts").alias("parts"))
        found = per.join(cut, "id", "full_outer").withColumn("parts", F.coalesce("parts", F.lit(0)))

    def wipe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for body, values, parts in zip(*(batch.column(n).to_pylist() for n in ("raw_body", "secrets", "parts"))):
                body = blanked(body, values) if body and values else body
                bodies.append(blank_parts(body, parts) if body and parts else body)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bodies, pa.string())], ["id", "raw_body"])

    return chunks.select("id", "raw_body").join(found, "id", "left").mapInArrow(wipe, "id long, raw_body string")
