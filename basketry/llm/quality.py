"""Quality rules by tokeniser fertility.

Two public vocabularies measure every whole text: characters per token under
each, the share of byte-fallback tokens (tokens that hold only a part of a
character) and the entropy of the token distribution. A document is rejected
when a measure leaves the band of its script. Text that a vocabulary cannot
compress, or that says the same few tokens over and over (symbol noise,
shouting, tables of separators), leaves them.

The bands of characters per token and of byte fallback follow the documents
themselves: quantiles over all documents of the script, with a margin, inside
fixed limits that some text of the script can pass (``LIMITS``). With n
documents of a script a bound lies n / (n + ``HALF``) of the way from the
wide end of the limits to there, whatever n is. A language of under ``LOW`` of a script's documents that both vocabularies know much worse
than the rest of the script can leave the bands.

The entropy of a short text is bounded by its length, so its lower bound is a
curve over the number of tokens. The base rules (too few words, too many
repeated 8-word windows) are measured in the same pass.

Texts are measured once, and nothing but the histogram of the measures is
shuffled. Defined results: a null text counts as empty; a text with fewer than ``min_words`` words fails
the base rule; null or repeated ids are kept as they are; an empty table
gives an empty result. Texts of any length are measured whole; a long one goes
to the tokenisers in pieces of ``PIECE`` characters or more, cut before a space
between two words, where no token can cross. Only a run of white space of
``RUN`` characters, which the tokenisers cannot take, is cut inside.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm.common import ship, table
from basketry.llm.pretokens import PATTERN

PIECE, RUN = 50_000, 500_000
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

#: Fixed values by script. ``per_token``: characters per token under each
#: vocabulary; ``fallback``: largest share of partial characters; each as
#: (where the bound is without documents, as far as documents may tighten it). Both ends lie where some text can be: a character is at most 4
#: byte tokens. ``entropy``: least bits at a number of tokens (straight lines
#: between, in the logarithm of the number).
LIMITS = {
    "latin": {"least": (1.3, 2.0), "most": (8.0, 6.0), "fallback": (0.35, 0.2),
              "entropy": ((8, 2.0), (32, 4.0), (96, 4.95), (192, 5.42), (384, 5.82),
                          (768, 6.1), (1536, 6.28), (3072, 6.36), (12288, 6.45))},
    "cyrillic": {"least": (0.6, 1.3), "most": (8.0, 4.0), "fallback": (0.9, 0.6),
                 "entropy": ((8, 1.5), (64, 3.0), (512, 4.0))},
    "cjk": {"least": (0.4, 0.7), "most": (4.0, 2.5), "fallback": (0.99, 0.97),
            "entropy": ((8, 1.5), (64, 3.0), (512, 4.0))},
    "other": {"least": (0.35, 0.6), "most": (8.0, 5.0), "fallback": (0.999, 0.995),
              "entropy": ((8, 1.0), (64, 2.0), (512, 3.0))},
}
#: Bands of a script without documents, and how many go half of the way.
BANDS = {name: {"per_token": (x["least"][0], x["most"][0]), "fallback": x["fallback"][0],
                "entropy": x["entropy"]} for name, x in LIMITS.items()}
HALF = 100
#: Quantiles that the bands start from, and the margins: a factor on the least
#: and on the largest characters per token, a part of the share that is left.
LOW, HIGH = 0.05, 0.99
LEAST_MARGIN, MOST_MARGIN, SHARE_MARGIN = 0.9, 2.0, 0.1
#: Histogram steps in one unit of a measure, and its largest value there.
STEPS, TOP = 500, 16.0
#: The letters of each script.
SCRIPTS = (("latin", r"\p{Latin}"), ("cyrillic", r"[\p{Cyrillic}\p{Greek}]"),
           ("cjk", r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]"))

MEASURES = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("script", T.StringType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("chars_per_token", T.DoubleType()),
    T.StructField("chars_per_token_2", T.DoubleType()),
    T.StructField("fallback_share", T.DoubleType()),
    T.StructField("token_entropy", T.DoubleType())])


@lru_cache(maxsize=4)
def vocabulary(path: str):
    """(tokeniser, flags of the tokens that hold only part of a character)."""
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    partial = np.zeros(max(ranks.values()) + 1, bool)
    for token, i in ranks.items():
        try:
            token.decode()
        except UnicodeDecodeError:
            partial[i] = True
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks,
                             special_tokens={}), partial


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a ``width``-word window found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        sums = np.zeros(n, np.uint64)
        for j in range(width):
            sums = sums * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    order = np.argsort(sums, kind="stable")
    ranked = sums[order]
    twin = ranked[1:] == ranked[:-1]
    if not twin.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][twin]] = True
    hit[order[:-1][twin]] = True
    at = np.flatnonzero(hit).tolist()
    seen = Counter(tuple(words[i:i + width]) for i in at)   # the words decide, not the hash
    cover = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i:i + width])] > 1:
            cover[i] += 1
            cover[i + width] -= 1
    return int((np.cumsum(cover) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode("utf-8", "replace").split()
    lines = Counter(x for x in text.split("\n") if x.strip(SPACES))
    return (len(words), len(text) - sum(map(text.count, SPACES)),
            sum(map(text.count, SYMBOLS)), sum(lines.values()) - len(lines),
            repeated_words(words))


_SCRIPTS = [(name, regex.compile(p)) for name, p in SCRIPTS]


def script_of(text: str) -> str:
    """The script of most letters; a text without letters is "other"."""
    if text.isascii():
        return "latin" if regex.search("[A-Za-z]", text) else "other"
    letters = Counter(text)
    best, most = "other", 0
    for name, p in _SCRIPTS:
        n = sum(c for ch, c in letters.items() if p.match(ch))
        if n > most:
            best, most = name, n
    rest = sum(c for ch, c in letters.items() if ch.isalpha()) - sum(
        c for ch, c in letters.items() if any(p.match(ch) for _, p in _SCRIPTS))
    return "other" if rest > most else best


_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
_RUN = re.compile(r"\s{%d}" % RUN)


def pieces(text: str):
    """The text in pieces of ``PIECE`` characters or more that its tokens do not
    cross, shorter only inside very long white space."""
    lo = 0
    while lo < len(text):
        cut = _CUT.search(text, lo + PIECE) if len(text) - lo > PIECE else None
        hi = cut.start() if cut else len(text)
        if hi - lo > RUN:
            for run in _RUN.finditer(text, lo, hi):
                yield text[lo:run.end()]
                lo = run.end()
        if hi > lo:
            yield text[lo:hi]
        lo = hi


def fertility(text: str, paths: tuple[str, str]) -> tuple[int, float, float, float, float]:
    """(tokens, characters per token under both vocabularies, byte-fallback
    share, entropy in bits); the last two under the first vocabulary."""
    if not text:
        return 0, 0.0, 0.0, 0.0, 0.0
    (one, partial), (two, _) = map(vocabulary, paths)
    counts = np.zeros(len(partial), np.int64) if len(text) > PIECE else None
    n = n2 = 0
    for piece in pieces(text):
        ids = np.array(one.encode_ordinary(piece), np.int64)
        n2 += len(two.encode_ordinary(piece))
        n += len(ids)
        if counts is not None:
            counts += np.bincount(ids, minlength=len(counts))
    if counts is None:
        ids.sort()
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        c = np.diff(np.concatenate((first, [n])))
        fallback = partial[ids].sum() / n
    else:
        fallback = counts[partial].sum() / n
        c = counts[counts > 0]
    p = c / n
    return n, len(text) / n, len(text) / max(n2, 1), float(fallback), float(-(p * np.log2(p)).sum())


def measure(text: Column, paths: tuple[str, str]) -> Column:
    """The measures of a text column, as a struct (see ``MEASURES``)."""

    @F.pandas_udf(MEASURES)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            t = t or ""
            rows.append((*base_counts(t), script_of(t), *fertility(t, paths)))
        return pd.DataFrame(rows, columns=MEASURES.names)

    # not evaluated again for each field that is read
    return run.asNondeterministic()(text)


def _floor(points, n: Column) -> Column:
    """Straight lines between (tokens, bits), in log2 of the tokens; below the
    first point nothing is asked, beyond the last its bits."""
    x = F.log2(n.cast("double"))
    out = F.lit(float(points[-1][1]))
    for (n0, y0), (n1, y1) in reversed(list(zip(points, points[1:]))):
        a, b = np.log2(n0), np.log2(n1)
        out = F.when(n < n1, F.lit(float(y0)) + (x - float(a)) * float((y1 - y0) / (b - a))
                     ).otherwise(out)
    return F.when(n < points[0][0], F.lit(0.0)).otherwise(out)


def base_failed(m: Column, min_words: int = 20, repeat_percent: int = 30) -> Column:
    return (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > repeat_percent * m["n_words"])


def in_bands(m: Column, bands: dict = BANDS) -> Column:
    """Whether the fertility measures lie in the bands of the script."""
    ok = F.lit(True)
    for name, band in bands.items():
        lo, hi = band["per_token"]
        # out of the band under both vocabularies: one alone may just not know the language
        bad = (((m["chars_per_token"] < lo) | (m["chars_per_token"] > hi))
               & ((m["chars_per_token_2"] < lo) | (m["chars_per_token_2"] > hi)))
        bad = bad | (m["fallback_share"] > band["fallback"])
        bad = bad | (m["token_entropy"] < _floor(band["entropy"], m["n_tokens"]))
        ok = F.when(m["script"] == name, ~bad).otherwise(ok)
    return ok


def histogram(measured: DataFrame) -> DataFrame:
    """(script, kind, step, n) of a frame with the measures ``m``: documents by
    the better (kind "least") and the worse ("most") of the two characters per
    token and by the share of partial characters ("fallback"), in steps of
    1 / ``STEPS``; empty texts are left out. Its size is bounded."""
    one, two = F.col("m")["chars_per_token"], F.col("m")["chars_per_token_2"]
    kinds = {"least": F.greatest(one, two), "most": F.least(one, two),
             "fallback": F.col("m")["fallback_share"]}
    steps = F.explode(F.array(*[F.struct(
        F.lit(k).alias("kind"),
        F.floor(F.least(v, F.lit(TOP)) * STEPS).cast("int").alias("step"))
        for k, v in kinds.items()])).alias("x")
    return measured.where(F.col("m")["n_tokens"] > 0).select(
        F.col("m")["script"].alias("script"), steps).groupBy(
        "script", "x.kind", "x.step").agg(F.count(F.lit(1)).alias("n"))


def bands_of(measured: DataFrame, limits: dict = LIMITS) -> dict:
    """The bands by script, from all documents of ``measured``."""
    seen: dict = {}
    for r in histogram(measured).collect():
        seen.setdefault((r["script"], r["kind"]), []).append((r["step"], r["n"]))

    def quantile(script, kind, q):
        steps, n = map(np.array, zip(*sorted(seen[script, kind])))
        return float(steps[np.searchsorted(np.cumsum(n), q * n.sum())]) / STEPS

    out = {}
    for name, x in limits.items():
        least, most, share = (x[k][0] for k in ("least", "most", "fallback"))
        n = sum(n for _, n in seen.get((name, "least"), []))
        if n:
            part = quantile(name, "fallback", HIGH)
            own = (np.clip(LEAST_MARGIN * quantile(name, "least", LOW), *x["least"]),
                   np.clip(MOST_MARGIN * quantile(name, "most", HIGH), *x["most"][::-1]),
                   np.clip(part + SHARE_MARGIN * (1 - part), *x["fallback"][::-1]))
            least, most, share = (w + (o - w) * n / (n + HALF)
                                  for w, o in zip((least, most, share), own))
        out[name] = {"per_token": (float(least), float(most)), "fallback": float(share),
                     "entropy": x["entropy"]}
    return out


def judge(docs: DataFrame, paths: tuple[str, str], bands: dict | None = None,
          carry: list[str] | None = None) -> DataFrame:
    """(doc, m, base_failed, kept): ``doc`` holds the row of ``docs`` as a
    struct, or its columns ``carry`` alone, ``m`` its measures. Without
    ``bands``, they come from the measures of all rows, which are written once."""
    ship(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("doc")
    out = docs.select(row, measure(F.col("text").cast("string"), paths).alias("m"))
    if bands is None:
        out = table(out, "quality-measures")
        bands = bands_of(out)
    failed = base_failed(F.col("m"))
    return out.select("doc", "m", failed.alias("base_failed"),
                      (~failed & in_bands(F.col("m"), bands)).alias("kept"))


def survivors(docs: DataFrame, paths: tuple[str, str], bands: dict | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects."""
    return judge(docs, paths, bands).where("kept").select("doc.*")
