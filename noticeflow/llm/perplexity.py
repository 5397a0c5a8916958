"""Quality rules: base rules on words, then the perplexity under the modified Kneser-Ney model of a document's language.

The models' n-grams are characters (order 5, in lower case): every task counts those of its texts, Spark sums
the counts of each language over all documents and makes the discounts, continuation counts, probabilities
and back-off weights by grouping and joining. In tables an n-gram is exact: two longs hold its characters,
21 bits each. To score, the models are sorted arrays of the 64-bit hashes of (language, order, n-gram) with
their log probabilities and back-off weights, so every document is scored under its own language's model alone.

Documents are scored by the model that they were counted for, so what the corpus has once is left out of the scores, not of
the model (left_out).

The tables grow with the corpus. Up to MODEL_ROWS rows the arrays are one broadcast. Beyond that texts are
dealt into chunks, each chunk asks for the n-grams that it holds, the model's rows are joined to what is
asked, and chunk and rows meet in one group (score_by_chunks): the same scores, with shuffles for a broadcast.

A document's score is the mean cost of its words in nats, those without a letter or digit added to the rest,
no word above WORD_CAP (a key or a number is one odd word, not an odd document). Each language has a band
around the scores of its documents: to both sides of the median it reaches as far as the fence for far outliers,
three interquartile ranges beyond a quartile, the range taken as twice the distance from the lower quartile to the
median, which a third of junk doesn't stretch much (LEAST_WIDTH at least), and ODD_WORDS words at the cap more, as
a few odd words weigh much in a short text. Outside, documents are rejected. No label is read.

A null language is a language of its own. Null texts count as empty and fail the base rules. A document that
fails the base rules isn't scored against the band and takes no part in it, but its text is counted. Every
row has its row in the result, also those that repeat an id or have none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ceil_div, saved, short_batches, with_side

ORDER, CHAR_BITS, HALF = 5, 21, 3
#: Rows of the models that are broadcast (16 bytes each), rows of texts in a chunk beyond that, rows that a task holds to sum.
MODEL_ROWS, CHUNK_CHARS, HELD_ROWS = 1 << 23, 16_000_000, 1_500_000
FENCE, LEAST_WIDTH, ODD_WORDS, WORD_CAP, DIGITS = 3.0, 1.0, 2, 25.0, 3
LEAST_WORDS, REPEAT_PERCENT, WINDOW_WORDS = 10, 20, 5
START, NO_LANGUAGE = 2, ""
WHITE = " \t\n\r\x0b\x0c"
#: Characters that count as symbols.
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in _SYMBOLS)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    word_chars = len(text) - sum(text.count(c) for c in WHITE)
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if line.strip():
            if line in seen:
                dup += 1
            seen.add(line)
    repeats = 0
    if len(words) >= WINDOW_WORDS + 1:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
        windows = ids[: len(ids) - WINDOW_WORDS + 1].copy()
        for k in range(1, WINDOW_WORDS):  # numbers of the windows, exact: pairs are numbered anew at every step
            windows = np.unique(windows * len(number) + ids[k : len(ids) - WINDOW_WORDS + 1 + k], return_inverse=True)[1].ravel()
        twice = np.bincount(windows)[windows] >= 2
        if twice.any():
            edge = np.zeros(len(ids) + 1, dtype=np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW_WORDS, -1)
            repeats = int((np.cumsum(edge)[:-1] > 0).sum())
    return len(words), word_chars, len(data.translate(None, _NOT_SYMBOLS)), dup, repeats


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' characters, one after the other: the ORDER-gram that ends there as two longs (its last HALF characters
    and those before; each text has ORDER - 1 start marks before it) and the character; and each text's length."""
    pad = chr(START) * (ORDER - 1)
    lowered = [(t or "").lower() for t in texts]
    lengths = np.array([len(t) for t in lowered], dtype=np.int64)
    codes = np.frombuffer("".join(pad + t for t in lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    real = np.ones(len(codes), dtype=bool)
    starts = np.cumsum([0, *(lengths + ORDER - 1)])[:-1]
    for k in range(ORDER - 1):
        real[starts + k] = False
    three = codes.copy()
    for k in range(1, HALF):
        three[k:] |= codes[:-k] << CHAR_BITS * k
    at = np.flatnonzero(real)
    return three[at - HALF] & ((1 << CHAR_BITS * (ORDER - HALF)) - 1), three[at], codes[at], lengths


_ALNUM = np.array([chr(i).isalnum() for i in range(0x110000)])
_WHITE = np.zeros(0x110000, dtype=bool)
_WHITE[[ord(c) for c in WHITE]] = True


def word_costs(costs: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each text's score from its characters' costs; 0 for empty texts. White space counts for the word after it."""
    score = np.zeros(len(lengths))
    if not len(codes):
        return score
    begins = _WHITE[codes].copy()
    ends = np.cumsum(lengths)
    begins[(ends - lengths)[lengths > 0]] = True
    word = np.cumsum(begins) - 1
    text = np.repeat(np.arange(len(lengths)), lengths)[begins]
    capped = np.minimum(np.bincount(word, weights=costs), WORD_CAP)
    spoken = np.bincount(word, weights=_ALNUM[codes]) > 0
    return np.bincount(text, weights=capped, minlength=len(lengths)) / np.maximum(1, np.bincount(text, weights=spoken, minlength=len(lengths)))


_SPREAD = np.int64(-7046029254386353131)


def _grouped(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs are neighbours, and where in it a new pair begins."""
    number = hi * _SPREAD + lo  # one sort of numbers; pairs that share one are told apart below
    order = np.argsort(number)
    number, h, o = number[order], hi[order], lo[order]
    new = np.ones(len(hi), dtype=bool)
    new[1:] = number[1:] != number[:-1]
    differ = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    if (differ & ~new[1:]).any():
        order = np.lexsort((lo, hi))
        h, o = hi[order], lo[order]
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return order, new


def _distinct(hi: np.ndarray, lo: np.ndarray, weights: np.ndarray | None = None):
    """The different pairs with how often each comes (or the sums of the weights)."""
    order, new = _grouped(hi, lo)
    at = np.flatnonzero(new)
    if not len(at):
        return hi, lo, np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(at, len(order))) if weights is None else np.add.reduceat(weights[order], at)
    return hi[order[at]], lo[order[at]], counts


def _by_language(langs, texts) -> dict[str, list[int]]:
    by: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        by.setdefault(lang or NO_LANGUAGE, []).append(k)
    return by


def _count(batches):
    held: dict[str, list[tuple]] = {}
    size = 0

    def joined(parts):
        return _distinct(*(np.concatenate([p[k] for p in parts]) for k in range(3)))

    for batch in batches:
        texts = batch.column(1).to_pylist()
        for lang, rows in _by_language(batch.column(0).to_pylist(), texts).items():
            hi, lo, _, _ = grams([texts[k] for k in rows])
            held.setdefault(lang, []).append(_distinct(hi, lo))
            size += len(held[lang][-1][0])
        if size > HELD_ROWS:
            held = {lang: [joined(parts)] for lang, parts in held.items()}
            size = sum(len(p[0][0]) for p in held.values())
            if size > HELD_ROWS // 2:  # what doesn't shrink is sent on
                yield from (_counted(lang, *p[0]) for lang, p in held.items())
                held, size = {}, 0
    for lang, parts in held.items():
        yield _counted(lang, *joined(parts))


def _counted(lang: str, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(hi), pa.string()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(counts, pa.int64())], ["lang", "hi", "lo", "c"])


def count_grams(docs: DataFrame, text="text", lang="lang") -> DataFrame:
    """(lang, hi, lo, c) over all documents."""
    short_batches(docs.sparkSession)
    return docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(_count, "lang string, hi long, lo long, c long").groupBy("lang", "hi", "lo").agg(F.sum("c").alias("c"))


def _mask(chars: int) -> Column:
    return F.lit((1 << CHAR_BITS * chars) - 1).cast("long")


def _last(n: int) -> list[Column]:
    """hi, lo of an n-gram's last n - 1 characters, as columns of their own."""
    hi = F.col("hi").bitwiseAND(_mask(n - 1 - HALF)) if n - 1 > HALF else F.lit(0).cast("long")
    lo = F.col("lo") if n - 1 >= HALF else F.col("lo").bitwiseAND(_mask(n - 1))
    return [hi.alias("low_hi"), lo.alias("low_lo")]


def _first(n: int) -> list[Column]:
    """hi, lo of an n-gram's first n - 1 characters."""
    carried = F.shiftleft(F.col("hi").bitwiseAND(_mask(1)), CHAR_BITS * (HALF - 1))
    return [F.shiftrightunsigned("hi", CHAR_BITS).alias("ctx_hi"), F.shiftrightunsigned("lo", CHAR_BITS).bitwiseOR(carried).alias("ctx_lo")]


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, n, hi, lo, logp, back, seen, used): for each n-gram of order n its log probability and how often the corpus has
    it, and the log back-off weight of its use as a context and how often it is one (null if never). It is the whole model:
    after each context the probabilities of all characters that follow it, and of the others by back-off, sum to one."""
    levels = {ORDER: counts.withColumn("r", F.col("c"))}
    for n in range(ORDER - 1, 0, -1):
        below = levels[n + 1].select("lang", "r", *_last(n + 1)).groupBy("lang", F.col("low_hi").alias("hi"), F.col("low_lo").alias("lo")).agg(F.count("*").alias("c"), F.sum("r").alias("r"))
        levels[n] = saved(below, f"kn-{n}")
    lower = None
    out, backs = None, None
    for n in range(1, ORDER + 1):
        level = levels[n]
        of = level.groupBy("lang").agg(F.count("*").alias("v"), *[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        ds = [F.coalesce(F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0)))), F.lit(0.5 * k)).alias(f"d{k}") for k in (1, 2, 3)]
        level = with_side(level, of.select("lang", "v", *ds), "lang", name="kn-discounts").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        level = level.select("lang", "hi", "lo", "c", "r", "d", "v", *_first(n), *_last(n))
        ctx = saved(level.groupBy("lang", "ctx_hi", "ctx_lo").agg(F.sum("c").alias("total"), F.sum("r").alias("ctx_r"), (F.sum("d") / F.sum("c")).alias("g")), f"kn-ctx-{n}")
        joined = level.hint("merge").join(ctx.drop("ctx_r"), ["lang", "ctx_hi", "ctx_lo"]).withColumn("own", F.greatest(F.lit(0.0), F.col("c") - F.col("d")) / F.col("total"))
        if lower is None:
            probs = joined.select("lang", "hi", "lo", "r", (F.col("own") + F.col("g") / (F.col("v") + 1)).alias("p"))
        else:
            probs = joined.hint("merge").join(lower.select("lang", F.col("hi").alias("low_hi"), F.col("lo").alias("low_lo"), F.col("p").alias("q")), ["lang", "low_hi", "low_lo"]).select("lang", "hi", "lo", "r", (F.col("own") + F.col("g") * F.col("q")).alias("p"))
            rows = ctx.select("lang", F.lit(n - 1).alias("n"), F.col("ctx_hi").alias("hi"), F.col("ctx_lo").alias("lo"), F.log("g").alias("back"), F.col("ctx_r").alias("used"))
            backs = rows if backs is None else backs.unionByName(rows)
        lower = saved(probs, f"kn-p-{n}")
        rows = lower.select("lang", F.lit(n).alias("n"), "hi", "lo", F.log("p").alias("logp"), F.col("r").alias("seen"))
        out = rows if out is None else out.unionByName(rows)
    return out.hint("merge").join(backs, ["lang", "n", "hi", "lo"], "full_outer")


def left_out(model: DataFrame) -> DataFrame:
    """(lang, n, hi, lo, logp, back) of a model for scoring the texts that it was counted on. What the corpus has once is the
    very place that is scored; it says nothing of that place, which backs off as if its text were left out. With it a
    document of odd characters would be likely by its own n-grams."""
    logp, back = F.when(F.col("seen") > 1, F.col("logp")), F.when(F.col("used") > 1, F.col("back"))
    return model.where("seen > 1 or used > 1").select("lang", "n", "hi", "lo", logp.alias("logp"), back.alias("back"))


def _hash_long(keys: np.ndarray, seed) -> np.ndarray:
    """Spark's xxhash64 of a long under a seed (one or one for each)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = seed + p5 + np.uint64(8)
        h = h ^ (rot(keys.view(np.uint64) * p2, 31) * p1)
        h = rot(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def hashes(lang: str, n: int, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return _hash_long(lo, _hash_long(hi, np.uint64(xxhash.xxh64_intdigest(f"{n} {lang}".encode(), 42)))).view(np.int64)


def hash_column() -> Column:
    return F.xxhash64(F.concat_ws(" ", F.col("n").cast("string"), "lang"), "hi", "lo")


@dataclass
class SortedModel:
    """Sorted hashes of n-grams with what belongs to each."""

    keys: np.ndarray
    logp: np.ndarray
    back: np.ndarray
    unseen: float = -12.0  # nats, for characters that no document of the language has

    @classmethod
    def of(cls, keys: np.ndarray, logp: np.ndarray, back: np.ndarray) -> SortedModel:
        order = np.argsort(keys)
        return cls(keys[order], logp.astype(np.float32)[order], back.astype(np.float32)[order])

    def score(self, lang: str, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Log probabilities of n-grams of the highest order."""
        out, weight = np.empty(len(hi)), np.zeros(len(hi))
        left = np.arange(len(hi))
        for n, hi, lo in parts(hi, lo):
            hi, lo = hi[left], lo[left]
            at, found = self._find(hashes(lang, n, hi, lo))
            found &= np.isfinite(self.logp[at])
            hit = left[found]
            out[hit] = weight[hit] + self.logp[at[found]]
            left, hi, lo = left[~found], hi[~found], lo[~found]
            if not len(left):
                return out
            if n > 1:
                at, found = self._find(hashes(lang, n - 1, *context(hi, lo)))
                back = np.where(found, self.back[at], 0.0)
                weight[left] += np.where(np.isfinite(back), back, 0.0)
        out[left] = weight[left] + self.unseen
        return out

    def _find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        order = np.argsort(wanted)  # in order the search stays in the cache
        at = np.empty(len(wanted), dtype=np.int64)
        at[order] = np.minimum(np.searchsorted(self.keys, wanted[order]), len(self.keys) - 1)
        return at, self.keys[at] == wanted


def parts(hi: np.ndarray, lo: np.ndarray):
    """(n, hi, lo) of the last n characters of n-grams, from ORDER down to 1."""
    for n in range(ORDER, 0, -1):
        yield n, hi & ((1 << CHAR_BITS * max(0, n - HALF)) - 1), lo & ((1 << CHAR_BITS * min(n, HALF)) - 1)


def context(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An n-gram without its last character."""
    return hi >> CHAR_BITS, (lo >> CHAR_BITS) | ((hi & ((1 << CHAR_BITS) - 1)) << CHAR_BITS * (HALF - 1))


def asked(hi: np.ndarray, lo: np.ndarray, lang: str) -> np.ndarray:
    """The hashes of all that scoring these n-grams may look up."""
    found = [hashes(lang, n, h, o) for n, h, o in parts(hi, lo)]
    found += [hashes(lang, n - 1, *context(h, o)) for n, h, o in parts(hi, lo) if n > 1]
    return np.unique(np.concatenate(found))


def scored_texts(model: SortedModel, langs: list[str | None], texts: list[str | None]) -> np.ndarray:
    """Each text's score under its language; every different n-gram is looked up once."""
    score = np.zeros(len(texts))
    for lang, rows in _by_language(langs, texts).items():
        hi, lo, codes, lengths = grams([texts[k] for k in rows])
        order, new = _grouped(hi, lo)
        of = np.empty(len(order), dtype=np.int64)
        of[order] = np.cumsum(new) - 1
        first = order[new]
        costs = -model.score(lang, hi[first], lo[first])[of]
        score[rows] = word_costs(costs, codes, lengths)
    return np.round(score, 6)


def _scorer(broadcast):
    def rows(batches):
        model: SortedModel = broadcast.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            counts = np.array([base_counts(t) for t in texts], dtype=np.int64).reshape(-1, 5)
            score = scored_texts(model, batch.column(1).to_pylist(), texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(counts[:, k], pa.int64()) for k in range(5)), pa.array(score, pa.float64())], ["doc_id", "lang", *COUNTS, "score"])

    return rows


def _asks(batches):
    for batch in batches:
        texts, chunks = batch.column(2).to_pylist(), batch.column(1).to_numpy()
        langs = batch.column(0).to_pylist()
        for chunk in np.unique(chunks).tolist():
            rows = [k for k, c in enumerate(chunks.tolist()) if c == chunk]
            for lang, of in _by_language([langs[k] for k in rows], texts).items():
                keys = asked(*grams([texts[rows[k]] for k in of])[:2], lang)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk), pa.int64()), pa.array(keys, pa.int64())], ["chunk", "h"])


def _scored_chunk(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    model = SortedModel.of(found["h"].to_numpy(np.int64), found["logp"].to_numpy(float), found["back"].to_numpy(float))
    texts = [t if isinstance(t, str) else None for t in docs["text"]]
    counts = np.array([base_counts(t) for t in texts], dtype=np.int64).reshape(-1, 5)
    return pd.DataFrame({"doc_id": docs["doc_id"].astype("Int64"), "lang": docs["lang"], **{c: counts[:, k] for k, c in enumerate(COUNTS)}, "score": scored_texts(model, docs["lang"].tolist(), texts)})


def score_by_chunks(rows: DataFrame, model: DataFrame) -> DataFrame:
    """The scores without a broadcast; model: (h, logp, back)."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(ceil_div(chars, CHUNK_CHARS) or 1)))
    dealt = saved(dealt, "kn-chunks")
    asks = dealt.select("lang", "chunk", "text").mapInArrow(_asks, "chunk long, h long").distinct()
    answers = saved(asks.hint("merge").join(model, "h"), "kn-answers")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_scored_chunk, SCORED)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCORED = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double"


def bands(scores: DataFrame) -> DataFrame:
    """(lang, middle, reach): from exact quartiles of the scores, which have at most WORD_CAP * 10**DIGITS values."""
    by = scores.where("not base_failed").groupBy("lang").agg(F.percentile(F.round("score", DIGITS), F.array(F.lit(0.25), F.lit(0.5))).alias("q"))
    middle, low = F.get("q", 1), F.get("q", 0)
    return by.select("lang", middle.alias("middle"), F.greatest((1 + 2 * FENCE) * (middle - low), F.lit(LEAST_WIDTH)).alias("reach"))


def scored(docs: DataFrame, doc_id="doc_id", text="text", lang="lang") -> DataFrame:
    """(doc_id, lang, counts, score), one row for each row of docs."""
    spark = docs.sparkSession
    counts = saved(count_grams(docs, text, lang), "kn-counts")
    model = saved(left_out(kneser_ney(counts)).select(hash_column().alias("h"), F.col("logp").cast("float").alias("logp"), F.col("back").cast("float").alias("back")), "kn-model")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).alias("text"))
    if model.count() > MODEL_ROWS:
        return score_by_chunks(rows, model)
    table = model.toArrow()
    arrays = SortedModel.of(table.column("h").to_numpy(), *(table.column(c).to_numpy(zero_copy_only=False) for c in ("logp", "back")))
    return rows.mapInArrow(_scorer(spark.sparkContext.broadcast(arrays)), SCORED)


def quality(docs: DataFrame, doc_id="doc_id", text="text", lang="lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity); the
    perplexity is that of a word."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    scores = saved(scored(docs, doc_id, text, lang).withColumn("base_failed", failed), "kn-scores")
    judged = with_side(scores, bands(scores), "lang", "left", "kn-bands")
    inside = F.coalesce(F.abs(F.col("score") - F.col("middle")) <= F.col("reach") + ODD_WORDS * WORD_CAP / F.col("n_words"), F.lit(True))
    return judged.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), F.round(F.exp("score"), 3).alias("perplexity"))


def filter_quality(docs: DataFrame, doc_id="doc_id", text="text", lang="lang") -> DataFrame:
    """docs without the documents that are rejected; where rows repeat an id, all go if one does. Rows with a null id stay."""
    gone = quality(docs, doc_id, text, lang).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("merge"), F.col(doc_id) == F.col("__gone"), "left_anti")
