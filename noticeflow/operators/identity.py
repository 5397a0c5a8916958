"""Identity of records: last wins, best of duplicates, probable duplicates across sources."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize
from .matching import ratios
from .snapshot import scratch

TITLE_RATIO, ORGANIZATION_RATIO = 0.88, 0.75


def last_wins(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def editorial_rank(status: Column) -> Column:
    return F.when(status == "approved", 0).when(status == "pending", 1).when(status == "hidden", 2).otherwise(3)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of normalised texts, a batch of pairs at a time; the order of the arguments matters."""
    return pd.Series(ratios(a.fillna("").tolist(), b.fillna("").tolist()))


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _piece_key(text: Column) -> list[Column]:
    """Length and two hashes of 64 bits; equal keys stand for equal texts."""
    return [F.length(text).alias("k"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")]


def _pieces(wholes: DataFrame, c: str, parts: DataFrame, p: str, *columns: str) -> DataFrame:
    """The parts of the texts in c that are as long as some text in p, by their keys. There are as many lengths as the names
    have, so a text has about as many pieces as characters for each of them."""
    lengths = sorted(r[0] for r in parts.where(F.length(p) > 0).select(F.length(p)).distinct().collect())
    fits = wholes.select(c, *columns, F.explode(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda k: k <= F.length(c))).alias("size"))
    at = F.sequence(F.lit(1), F.length(c) - F.col("size") + 1)
    return fits.select(c, *columns, F.explode(F.transform(at, lambda i: F.substring(F.col(c), i, F.col("size")))).alias("piece")).select(c, *columns, *_piece_key(F.col("piece")))


def overlapping_region(issuers: DataFrame, sources: DataFrame) -> DataFrame:
    """(i, region): for each distinct issuer name i, the region of the source (id, region, o) whose name is part of it or holds
    it, with the longest shared text, of equals the smallest id. Names are non-empty.

    Containment is an equality join: a name is part of another if it equals one of its pieces. Sources whose name is part of
    an issuer meet the issuer's pieces; for issuers that are part of sources only the first source of each piece counts, so
    a word that most names hold is one row."""
    key = ["k", "h", "g"]
    issuers = kept(issuers, "issuers")
    names = kept(sources.groupBy("o").agg(F.min(F.struct(F.col("id").alias("sid"), "region")).alias("s")), "source-names")
    inner = _pieces(issuers, "i", sources, "o").hint("merge").join(names.where(F.length("o") > 0).select(*_piece_key(F.col("o")), "s"), key).select("i", "k", "s")
    firsts = _pieces(names, "o", issuers, "i", "s").groupBy(*key).agg(F.min("s").alias("s"))
    outer = issuers.where(F.length("i") > 0).select("i", *_piece_key(F.col("i"))).hint("merge").join(firsts, key).select("i", "k", "s")
    return inner.unionByName(outer).groupBy("i").agg(F.max_by("s.region", F.struct("k", -F.col("s.sid"))).alias("region"))


def _spared(size: Column, least: float, q: int) -> Column:
    """How many of a text's pieces of q characters, the rarest first, hold one that it shares with any text at a ratio of
    `least` or more; null where that says nothing.

    Of two texts with together s characters at least s * least / 2 are matched, in no more blocks than the s * (1 - least)
    unmatched characters and one; a block loses q - 1 pieces. The other text can't be so short that s is below
    2 size / (2 - least)."""
    share = least / 2 - (q - 1) * (1 - least)
    shared = F.ceil(size * F.lit(2 / (2 - least) * share - 1e-12) - F.lit(q - 1 + 1e-9))
    return F.when(shared >= 1, size - q + 1 - shared + 1)


def _last_short(least: float, q: int) -> int:
    """Texts of at most so many characters have no pieces that they must share."""
    return int((q - 1) * (2 - least) / (2 * (least / 2 - (q - 1) * (1 - least)))) + 1


def rare_pieces(texts: DataFrame, c: str, least: float, q: int) -> DataFrame:
    """(c, token): for each distinct non-empty text in c the rare pieces of q characters, each with its how-many-eth occurrence,
    of which texts with a ratio of `least` share one; for short texts, and those that may be like one, their characters."""
    size = F.length(c)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - q + 1, F.lit(1))), lambda at: F.substring(F.col(c), at, F.lit(q)))
    numbered = F.transform(grams, lambda x, i: F.concat(x, F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda y: y == x)).cast("string")))
    each = kept(texts.where(size > 0).select(c, F.explode(numbered).alias("token")), "pieces")
    counts = each.groupBy("token").agg(F.count("*").alias("n"))
    ordered = each.hint("merge").join(counts.hint("merge"), "token").groupBy(c).agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("all"))
    rare = ordered.withColumn("most", _spared(size, least, q)).where("most is not null").select(c, F.explode(F.slice("all", F.lit(1), F.col("most").cast("int"))).alias("e")).select(c, "e.token")
    short = texts.where((size > 0) & (size <= _last_short(least, q) * (2 - least) / least)).select(c, F.explode(F.array_distinct(F.split(F.col(c), ""))).alias("token")).withColumn("token", F.concat(F.lit("\n"), "token"))
    return kept(rare.unionByName(short), "rare-pieces")


def _alike(a: str, b: str, least: float) -> Column:
    """The ratio of different texts reaches `least`; the unmatched characters bound the edits, which cost less to count."""
    both = F.length(a) + F.length(b)
    return (2 * F.least(F.length(a), F.length(b)) >= least * both) & (F.levenshtein(a, b) <= both * F.lit(1 - least) + F.lit(1e-9)) & (similarity(a, b) >= least)


def similar_texts(texts: DataFrame, others: DataFrame, least: float, q: int) -> DataFrame:
    """(a, b): all pairs of a text in column a of texts and one in column b of others, equal ones too, with a ratio of `least`.
    The others hold all texts."""
    pieces = rare_pieces(others, "b", least, q)
    own = pieces.withColumnRenamed("b", "a").hint("merge").join(texts.hint("merge"), "a", "left_semi")
    pairs = kept(own.hint("merge").join(pieces, "token").where("a <> b").select("a", "b").distinct(), "similar-candidates")
    return kept(pairs.where(_alike("a", "b", least)).unionByName(texts.select("a", F.col("a").alias("b"))), "similar")


#: Places of a list that are searched one by one, and asking classes in a group; pieces by which titles and names meet.
LIST, ASKS, TITLE_Q, NAME_Q = 512, 2048, 3, 2
#: Rows of an Arrow batch of the search; one has up to about ASKS classes and LIST targets.
SEARCH_ROWS = 64


def _by_asks(batches):
    """Batches cut where they have ASKS asking classes, so that what is compared together is bounded by ASKS and LIST."""
    for batch in batches:
        before = np.cumsum([0, *batch.column(2).value_lengths().to_pylist()])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(before, before[at] + ASKS, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def _searched(batches):
    """Rows of a group: its asking classes, and the beginning of its list of targets by id. The targets are compared in steps
    of growing width until each class has its first one or the list is at its end."""
    for batch in _by_asks(batches):
        t, of, asks, targets, cut = (c.to_pylist() for c in batch.columns)
        name: dict[str, int] = {}
        number = lambda x: name.setdefault(x, len(name))
        rows = [(g, number(x["o"]), x["source_id"], x["day"], x["last"]) for g, some in enumerate(asks) for x in some]
        group, own, source, last = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1, 2, 4))
        begin = np.cumsum([0, *map(len, targets)])
        flat = [x for some in targets for x in some]
        first, their_source, theirs = (np.array([f(x) for x in flat], dtype=np.int64) for f in (lambda x: x["first"], lambda x: x["source_b"], lambda x: number(x["ob"])))
        texts = list(name)
        found = np.full(len(rows), -1, dtype=np.int64)
        at, end, step = begin[group], begin[group + 1], 8
        live = np.flatnonzero(at < end)
        known: dict[int, bool] = {}
        while len(live):
            width = np.minimum(end[live] - at[live], step)
            ask = np.repeat(live, width)
            place = np.repeat(at[live] - (np.cumsum(width) - width), width) + np.arange(width.sum())
            fits = (their_source[place] != source[ask]) & (first[place] < last[ask])
            ask, place = ask[fits], place[fits]
            pair = own[ask] * len(texts) + theirs[place]
            new = [k for k in np.unique(pair).tolist() if k not in known]
            left, right = [texts[k // len(texts)] for k in new], [texts[k % len(texts)] for k in new]
            known |= zip(new, (ratios(left, right) >= ORGANIZATION_RATIO).tolist(), strict=True)
            good = np.fromiter(map(known.__getitem__, pair.tolist()), dtype=bool, count=len(pair))
            hit, where = np.unique(ask[good], return_index=True)
            found[hit] = first[place[good][where]]
            at[live] += width
            step *= 4
            live = live[(found[live] < 0) & (at[live] < end[live])]
            live = live[first[at[live]] < last[live]]
        more = [bool(found[k] < 0 and cut[r[0]] is not None and cut[r[0]] < r[4]) for k, r in enumerate(rows)]
        columns = [pa.array([t[r[0]] for r in rows], pa.string()), pa.array([texts[r[1]] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string()), pa.array(source, pa.int64()), pa.array([of[r[0]] for r in rows], pa.string()), pa.array(last, pa.int64()), pa.array([x if x >= 0 else None for x in found.tolist()], pa.int64()), pa.array(more, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["t", "o", "day", "source_id", "of", "last", "duplicate_of", "more"])


def probable_duplicates(notices: DataFrame) -> DataFrame:
    """(id, duplicate_of): for each notice the smallest id among smaller ids of other sources, approved and not closed, with
    similar title and organisation, and the same deadline day where both have one.

    Equal (title, organisation, day, source) rows are one class. Targets lie in lists by day, all undated ones in one, and all
    in one; a class with a day asks the lists of its day and of the undated, one without a day that of all. Similar titles are
    found among the distinct ones by rare pieces. For each title and list the LIST smallest ids of similar titles are searched
    in order, which ends at the first similar organisation; a class that may have one beyond them asks for the organisations
    that share rare pieces with its own. No pair is lost either way, and the search costs at most LIST comparisons a class
    where names are alike, and the pieces' candidates where they aren't."""
    rows = notices.select("id", F.col("source_id").cast("long").alias("source_id"), normalize(F.col("title")).alias("t"), normalize(F.col("organization")).alias("o"), F.coalesce(F.date_format("deadline", "yyyy-MM-dd"), F.lit("")).alias("day"), ((F.col("editorial_status") == "approved") & (F.col("status") != "closed")).alias("target"))
    key = ["t", "o", "day", "source_id"]
    classes = kept(rows.groupBy(*key).agg(F.min(F.when(F.col("target"), F.col("id"))).alias("first"), F.max("id").alias("last")), "classes")
    titles = classes.select("t").distinct()
    alike = similar_texts(titles.select(F.col("t").alias("a")), titles.select(F.col("t").alias("b")), TITLE_RATIO, TITLE_Q).select(F.col("a").alias("t"), F.col("b").alias("tb"))
    own = F.when(F.col("day") == "", F.array(F.lit("all"), F.lit("undated"))).otherwise(F.array(F.lit("all"), F.col("day")))
    targets = classes.where("first is not null").select(F.explode(own).alias("of"), F.col("t").alias("tb"), F.col("o").alias("ob"), F.col("source_id").alias("source_b"), "first")
    by_id = lambda t: Window.partitionBy(t, "of").orderBy("first", "source_b", "ob")
    heads = kept(targets.withColumn("k", F.row_number().over(by_id("tb"))).where(F.col("k") <= LIST + 1).drop("k"), "heads")
    merged = heads.hint("merge").join(alike.hint("merge"), "tb").withColumn("k", F.row_number().over(by_id("t"))).where(F.col("k") <= LIST + 1)
    lists = merged.groupBy("t", "of").agg(F.array_sort(F.collect_list(F.when(F.col("k") <= LIST, F.struct("first", "source_b", "ob")))).alias("targets"), F.max(F.when(F.col("k") > LIST, F.col("first"))).alias("cut"))
    asked = F.when(F.col("day") == "", F.array(F.lit("all"))).otherwise(F.array(F.lit("undated"), F.col("day")))
    asks = classes.select(*key, "last", F.explode(asked).alias("of"))
    salted = asks.groupBy("t", "of").agg(F.ceil(F.count("*") / ASKS).cast("long").alias("salts"))
    asks = asks.hint("merge").join(salted.hint("merge"), ["t", "of"]).withColumn("salt", F.pmod(F.xxhash64("o", "source_id", "day"), F.col("salts")))
    groups = asks.groupBy("t", "of", "salt").agg(F.collect_list(F.struct("o", "source_id", "day", "last")).alias("asks"))
    met = groups.hint("merge").join(lists.hint("merge"), ["t", "of"]).select("t", "of", "asks", "targets", "cut")
    met.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SEARCH_ROWS))
    found = kept(met.mapInArrow(_searched, "t string, o string, day string, source_id long, of string, last long, duplicate_of long, more boolean"), "searched")
    hits = found.where("duplicate_of is not null").select(*key, "duplicate_of")
    open_ = found.where("more").drop("duplicate_of", "more")
    if not open_.isEmpty():
        names = similar_texts(open_.select(F.col("o").alias("a")).distinct(), classes.select(F.col("o").alias("b")).distinct(), ORGANIZATION_RATIO, NAME_Q)
        firsts = targets.groupBy("of", "tb", "ob", "source_b").agg(F.min("first").alias("first"))
        wide = open_.hint("merge").join(alike.hint("merge"), "t").hint("merge").join(names.select(F.col("a").alias("o"), F.col("b").alias("ob")).hint("merge"), "o")
        rest = wide.hint("merge").join(firsts.hint("merge"), ["of", "tb", "ob"]).where("source_b <> source_id and first < last").select(*key, F.col("first").alias("duplicate_of"))
        hits = hits.unionByName(rest)
    best = hits.groupBy(*key).agg(F.min("duplicate_of").alias("duplicate_of"))
    return rows.hint("merge").join(best.hint("merge"), key).where("duplicate_of < id").select("id", "duplicate_of")
