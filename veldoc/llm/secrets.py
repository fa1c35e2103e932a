"""Secret scans.

Base spans come from three fixed patterns. Beside them, the values that stand in a credential context
(a word such as password, key or bearer, then a separator) are scored by the number of guesses a password
cracker would need: dynamic programming splits the value at least cost into dictionary words, dates, repeats,
keyboard walks and brute-force spans. The dictionary is a short list of common passwords and, where a tokenizer's file
is named, the words of its vocabulary in the order of its merges, which follows their frequency (tens of thousands). A value that takes `min_log10` guesses or more is a span of kind `guess`.

Every row is scanned by itself, so nothing is shuffled and a lost executor costs its own rows only.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from veldoc.llm.common import small_batches

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")
#: Parts of the words in ASSIGN: a text without any of them has no match.
ASSIGN_PARTS = ("passw", "secret", "token", "api_key", "apikey")

#: The word may begin behind an underscore. Behind bearer a blank is enough in an authorization header, and elsewhere
#: where the value has a digit or 20 characters, unlike prose.
CONTEXT = re.compile(r"""(?<![A-Za-z0-9])(?:(?:pwd|pass|passphrase|passcode|pin|auth|bearer|credentials?|private[_ ]key|access[_ ]key|client[_ ]secret|secret[_ ]key)["']?\x20*[:=]\x20*["']?|authorization["']?\x20*[:=]\x20*["']?bearer\x20+|bearer\x20+(?=[^\s"'<>,;]{0,256}\d|[^\s"'<>,;]{20}))([^\s"'<>,;]{6,})""", re.I | re.A)
CONTEXT_PARTS = ("pwd", "pass", "pin", "auth", "bearer", "credential", "private", "access", "secret")

#: Common words of passwords, most common first.
COMMON = "password secret admin login welcome letmein monkey dragon master hello user root test token access key guest love sunshine princess football baseball superman batman shadow summer winter spring autumn default example changeme company server database private public".split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_AT = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")
_LEET = str.maketrans("4@301!5$7", "aaeoiisst")


def _near(a: str, b: str) -> bool:
    p, q = _AT.get(a), _AT.get(b)
    return bool(p and q) and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


@lru_cache(2)
def dictionary(tokenizer: str | None) -> dict[str, int]:
    """Rank of each word of 3 to 12 letters: common passwords first, then whole words of a tokenizer's vocabulary."""
    if tokenizer is None:
        return RANK
    with open(tokenizer, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    found = (t.removesuffix("</w>").removeprefix("\u0120") for t in sorted(vocab, key=vocab.get) if t.endswith("</w>") or t.startswith("\u0120"))
    names = dict.fromkeys([*COMMON, *(w.lower() for w in found if 3 <= len(w) <= 12 and w.isascii() and w.isalpha())])
    return {w: i + 1 for i, w in enumerate(names)}


def guess_cost(value: str, enough: float = math.inf, ranks: dict[str, int] = RANK) -> float:
    """log10 of the guesses for the cheapest split of `value` into spans.

    A word costs its rank (doubled where it has capitals or digits for letters), a date 365 days times 100 years at
    most, a repeat the cost of its unit times the repetitions, a keyboard walk its start, length and turns, and a
    brute-force span 10 guesses for each digit, 26 for a letter of one case and 95 for any other character,
    times the alphabet's change. Each span after the first doubles the guesses. The empty value costs 0.
    Ends with a number of at least `enough` as soon as no split can cost less: words and dates take 12 characters at
    most, so where no repeat or walk of 12 goes on, each split has a boundary among the last 12 places.
    """
    n, low = len(value), value.lower()
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n
    dates: dict[int, list[int]] = {}
    for m in re.finditer(r"(?=(\d{4}|\d[\d/.-]{3,9}))", value):
        for size in range(4, 11):
            if _DATE.fullmatch(value, m.start(), min(n, m.start() + size)) and m.start() + size <= n:
                dates.setdefault(m.start() + size, []).append(m.start())
    walk = [0] * (n + 1)
    turns = [0] * (n + 1)
    step = None
    for i in range(1, n + 1):
        if i > 1 and _near(low[i - 2], low[i - 1]):
            p, q = _AT[low[i - 2]], _AT[low[i - 1]]
            now = (q[0] - p[0], q[1] - p[1])
            walk[i], turns[i] = (walk[i - 1] or 1) + 1, turns[i - 1] + (now != step)
            step = now
        else:
            walk[i], turns[i], step = 1, 0, None
    again = [0] * 9  # by unit: characters up to here that equal the one a unit before
    for i in range(1, n + 1):
        c = value[i - 1]
        single = 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 95
        # a character more of a brute-force span; a change of its class opens a new one
        same = i > 1 and (value[i - 2].isdigit(), value[i - 2].islower(), value[i - 2].isupper()) == (c.isdigit(), c.islower(), c.isupper())
        best[i] = best[i - 1] + math.log10(single) + (0.0 if same or i == 1 else math.log10(2) / 2)
        joined = lambda j: best[j] + (math.log10(2) if j else 0.0)
        for size in range(3, min(i, 12) + 1):
            j = i - size
            for form, factor in ((low[j:i], 1), (plain[j:i], 2)):
                if rank := ranks.get(form):
                    cased = 2 if value[j:i] != low[j:i] else 1
                    best[i] = min(best[i], joined(j) + math.log10(rank * factor * cased + 1))
        for j in dates.get(i, ()):
            best[i] = min(best[i], joined(j) + math.log10(36500 if i - j > 4 else 119))
        for unit in range(1, min(8, i - 1) + 1):
            again[unit] = again[unit] + 1 if value[i - 1 - unit] == c else 0
            times = 1 + again[unit] // unit
            if times >= 2 and (unit > 1 or times >= 3):
                j = i - times * unit
                kind = sum(math.log10(10 if x.isdigit() else 26) for x in value[i - unit : i])
                best[i] = min(best[i], joined(j) + kind + math.log10(times))
        if walk[i] >= 3:
            j = i - walk[i]
            best[i] = min(best[i], joined(j) + math.log10(47 * walk[i]) + turns[i] * math.log10(5))
        if best[i] >= enough and i > 12 and walk[i] < 12 and all(again[u] < 12 - u for u in range(1, 9)) and min(best[i - 12 : i]) >= enough:
            return min(best[i - 12 : i + 1])
    return best[n]


def scan(text: str | None, min_log10: float = 8.0, ranks: dict[str, int] = RANK) -> list[tuple[int, int, int]]:
    """(start, end, kind) of every span of one text, in code points, by start, then kind."""
    if not text:
        return []
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    out = []
    if any(part in low for part in ASSIGN_PARTS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    values = [m.span(1) for m in CONTEXT.finditer(text)] if any(part in low for part in CONTEXT_PARTS) else []
    values += [ASSIGN.match(text, a).span(2) for a, b, k in out if k == 0]
    out += [(a, b, 3) for a, b in sorted(set(values)) if guess_cost(text[a:b], min_log10, ranks) >= min_log10]
    return sorted(out, key=lambda x: (x[0], x[2]))


def find_secrets(df: DataFrame, text_col: str = "text", out_col: str = "secret_spans", min_log10: float = 8.0, tokenizer: str | None = None) -> DataFrame:
    """`df` and an array of struct(kind, start, end, text): all spans of the text by start, then kind.

    Null and empty texts have an empty array. Rows are kept as they are, repeated ones too. A column that has the
    name `out_col` is replaced. Values of any length are judged in full, and their spans are whole. `tokenizer`: path of
    a tokenizer's file, on all executors, whose vocabulary is the dictionary.
    """

    small_batches(df.sparkSession)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,text:string>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": KINDS[k], "start": a, "end": b, "text": t[a:b]} for a, b, k in scan(t, min_log10, dictionary(tokenizer))] for t in texts])

    return df.withColumn(out_col, spans(F.col(text_col)))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", min_log10: float = 8.0, tokenizer: str | None = None) -> DataFrame:
    """Every span of the text replaced by `mark`, overlapping spans by one. Null stays null."""

    small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            found, out, at = scan(t, min_log10, dictionary(tokenizer)), [], 0
            for a, b, _ in found:
                if a >= at:
                    out += [t[at:a], mark]
                at = max(at, b)
            return t if not found else "".join(out) + t[at:]

        return texts.map(one)

    return df.withColumn(text_col, clean(F.col(text_col)))


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, a digest of base spans and all spans, for each row of `documents`."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for spans in b["spans"]:
                all_of = [f"{x['kind']}:{x['start']}:{x['end']}" for x in spans]
                base = [s for s in all_of if not s.startswith("guess")]
                kinds = [s[: s.index(":")] for s in base]
                out.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(all_of)))
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])], axis=1)

    found = find_secrets(docs, out_col="spans", tokenizer=public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "spans")
    return found.mapInPandas(digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
