"""Near-duplicate functions or short texts by trigrams, as an option of the dry rule.

Not part of the default run.  records: id, language, text; the similarity is
the Jaccard index of character trigrams, and texts whose lengths differ by
more than the length ratio are never compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.texts import trigrams
from ..session import shared_folder
from . import gramsets

#: A cell of the exact join has two parts of at most about so many texts and characters; a larger band is cut by lengths.
PART_TEXTS, PART_CHARACTERS, BAND_TEXTS = 8192, 1 << 22, 4096
_TASKS = 64


def _length_class(n: Column, length_ratio: float) -> Column:
    """Texts whose lengths fit are in the same class or in neighbouring ones; the empty text is alone."""
    if length_ratio <= 0:
        return F.lit(0)
    if length_ratio >= 1:
        return n * 2
    return F.when(n == 0, F.lit(-2)).otherwise(F.floor(F.ln(n) / (-math.log(length_ratio) * (1 + 1e-9)))).cast("int")


def rounded(similarity: Column) -> Column:
    """To three places as SQL does it: the double times 1000, rounded, over 1000 (0.5075 is less than its decimals say)."""
    return F.round(similarity * 1000) / 1000


def _tasks(df: DataFrame) -> int:
    return max(_TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _with_least(records: DataFrame) -> DataFrame:
    """records with the least 16 hashes of each text's trigrams, four bytes each."""
    schema = T.StructType([f for f in records.schema.fields if f.name in ("id", "language", "text")] + [T.StructField("least", T.BinaryType())])

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(gramsets.least_hashes(gramsets.as_strings(b["text"])), pa.binary())], [*b.schema.names, "least"])

    return records.select(*schema.names[:-1]).mapInArrow(work, schema)


def _band_candidates(id_type: T.DataType, threshold: float, length_ratio: float, most: int):
    """For sorted rows of bands: each record's best candidates of a band that share no band before, with what they have in common."""
    one = T.StructType([T.StructField("key", T.LongType()), T.StructField("a", id_type), T.StructField("common", T.IntegerType()), T.StructField("whole", T.IntegerType())])
    schema = T.StructType([T.StructField("b", id_type), T.StructField("candidates", T.ArrayType(one))])

    def band_codes(least: list[bytes]) -> np.ndarray:
        known: dict[bytes, int] = {}
        return np.array([[known.setdefault(x[j : j + 16], len(known)) if len(x) > j else -1 for j in range(0, 64, 16)] for x in least], np.int64).reshape(-1, 4)

    def found(t: pa.Table, starts: np.ndarray):
        sets, codes = gramsets.Sets(gramsets.as_strings(t["text"].combine_chunks())), band_codes(t["least"].to_pylist())
        n, k, home = (t[c].to_numpy() for c in ("n", "k", "home"))
        ids = t["id"].combine_chunks()
        for i, j in zip(starts, [*starts[1:], len(t)], strict=True):
            if j - i < 2:
                continue
            order = gramsets.places(ids.slice(i, j - i))
            for b, a, key in gramsets.best_in_band(n[i:j], order, codes[i:j], int(k[i]), home[i:j], length_ratio, most):
                by = np.argsort(b, kind="stable")
                b, a, key = b[by] + i, a[by] + i, key[by]
                common = sets.common(a, b)
                whole = sets.size[a] + sets.size[b] - common
                # a place in this band orders nothing beyond it: the id itself does
                key >>= 26
                cut = np.flatnonzero(np.diff(b, prepend=-1))
                values = pa.StructArray.from_arrays([pa.array(key), ids.take(pa.array(a)), pa.array(common.astype(np.int32)), pa.array(whole.astype(np.int32))], ["key", "a", "common", "whole"])
                if len(cut):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(b[cut])), pa.ListArray.from_arrays(pa.array([*cut, len(b)], pa.int32()), values)], ["b", "candidates"])

    def work(batches):
        held, rows = [], 0

        def whole_bands(t: pa.Table, last: bool):
            """The table cut before its last band, which may go on."""
            names = ("language", "k", "band", "part")
            new = np.zeros(len(t), bool)
            new[:1] = True
            for c in names:
                v = t[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(new)
            return (starts, len(t)) if last else (starts[:-1], int(starts[-1]))

        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= BAND_TEXTS or sum(x.nbytes for x in held) > 4 * PART_CHARACTERS:
                t = pa.Table.from_batches(held).combine_chunks()
                starts, end = whole_bands(t, False)
                if end:
                    yield from found(t.slice(0, end), starts)
                held, rows = t.slice(end).to_batches(), len(t) - end
        if rows:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from found(t, whole_bands(t, True)[0])

    return work, schema


def band_pairs(records: DataFrame, threshold: float = 0.99, length_ratio: float = 0.75, most_candidates: int = 300) -> DataFrame:
    """(a, b, similarity) of records that share a band and are similar; a < b.

    A band is four of the least 16 hashes of the trigrams in order.  Of the
    candidates of one record the 300 with most shared bands are compared:
    nearest in length first among equals, then least id.

    Every band is worked through where its records meet, so no pair travels but
    the best of each record and band; a pair counts in the first band it shares.
    Bands of many records are cut by lengths, with each record a candidate in
    the neighbouring classes too.
    """
    r = _with_least(records.filter("text IS NOT NULL AND language IS NOT NULL AND id IS NOT NULL"))
    k = F.explode(F.sequence(F.lit(0), F.floor((F.length("least") - 1) / 16).cast("int"))).alias("k")
    key = ("language", "k", "band")
    band = F.expr("substring(least, 16 * k + 1, 16)").alias("band")
    # at most four of 4096 records are such bands
    large = _with_least(records.filter("text IS NOT NULL AND language IS NOT NULL")).select("language", "least", k).select("language", "k", band).groupBy(*key).count().filter(F.col("count") > BAND_TEXTS).select(*key, F.lit(True).alias("large"))
    placed = r.select("id", "language", "text", "least", F.length("text").alias("n"), k).select("*", band).join(F.broadcast(large), [*key], "left")
    own = _length_class(F.col("n"), length_ratio)
    parts = F.when(F.col("large"), F.array(own - 1, own, own + 1)).otherwise(F.array(F.lit(None).cast("int")))
    dealt = placed.withColumn("own", own).withColumn("part", F.explode(parts)).withColumn("home", F.coalesce(F.col("part") == F.col("own"), F.lit(True)))
    work, schema = _band_candidates(records.schema["id"].dataType, threshold, length_ratio, most_candidates)
    met = dealt.select("id", "language", "text", "least", "n", "k", "band", "part", "home").repartition(_tasks(records), *key, "part").sortWithinPartitions(*key, "part")
    found = met.mapInArrow(work, schema)
    best = found.groupBy("b").agg(F.slice(F.array_sort(F.flatten(F.collect_list("candidates"))), 1, most_candidates).alias("c"))
    s = F.col("common") / F.col("whole")
    return best.select("b", F.inline("c")).filter(s >= threshold).select("a", "b", rounded(s).alias("similarity"))


def _texts(records: DataFrame) -> DataFrame:
    """Every distinct text of a language once, with the digest that stands for it."""
    r = records.filter("text IS NOT NULL AND language IS NOT NULL").select("language", "text", F.unhex(F.md5("text")).alias("digest"))
    return r.groupBy("language", "digest").agg(F.first("text").alias("text"))


def _similar_texts(texts: DataFrame, threshold: float, length_ratio: float) -> DataFrame:
    """(language, one, two, common, whole) of all pairs of different texts that are similar, by digests, each once.

    Lengths fall into classes so that only texts of the same or of neighbouring
    ones can be similar, and a class of a language into parts of bounded size.
    Each two parts meet in one cell, where every pair is compared by bits; what
    travels are the texts, once for each part they meet.
    """
    t = texts.withColumn("n", F.length("text")).withColumn("class", _length_class(F.col("n"), length_ratio))
    # a row for each language and class, of which there are some dozens
    sizes = t.groupBy("language", "class").agg(F.ceil(F.greatest(F.count("*") / PART_TEXTS, F.sum("n") / PART_CHARACTERS)).cast("int").alias("parts")).withColumn("parts", F.greatest("parts", F.lit(1)))
    beside = lambda step, name: sizes.select("language", (F.col("class") + step).alias("class"), F.col("parts").alias(name))
    sizes = sizes.join(beside(-1, "above"), ["language", "class"], "left").join(beside(1, "below"), ["language", "class"], "left")
    c, p, upto = F.col("class"), F.col("part"), lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda c1, p1, c2, p2, side: F.struct(c1.alias("c1"), p1.alias("p1"), c2.alias("c2"), p2.alias("p2"), side.cast("boolean").alias("second"))
    cells = F.concat(
        F.transform(upto(F.col("parts")), lambda j: cell(c, F.least(p, j), c, F.greatest(p, j), j < p)),
        F.transform(upto(F.col("above")), lambda j: cell(c, p, c + 1, j, F.lit(False))),
        F.transform(upto(F.col("below")), lambda j: cell(c - 1, j, c, p, F.lit(True))),
    )
    key = ["language", "c1", "p1", "c2", "p2"]
    placed = t.join(F.broadcast(sizes), ["language", "class"]).withColumn("part", F.pmod(F.hash("digest"), F.col("parts"))).select("language", "digest", "text", "n", F.inline(cells))
    schema = T.StructType([T.StructField("language", texts.schema["language"].dataType), *(T.StructField(x, T.BinaryType()) for x in ("one", "two")), *(T.StructField(x, T.IntegerType()) for x in ("common", "whole"))])

    def work(t: pa.Table) -> pa.Table:
        empty = pa.Table.from_pydict({"language": t["language"].slice(0, 0), "one": pa.array([], pa.binary()), "two": pa.array([], pa.binary()), "common": pa.array([], pa.int32()), "whole": pa.array([], pa.int32())})
        within = t["c1"][0] == t["c2"][0] and t["p1"][0] == t["p2"][0]
        second, n = t["second"].to_numpy(), t["n"].to_numpy().astype(np.int64)
        x, y = np.flatnonzero(~second), None if within else np.flatnonzero(second)
        if not len(x) or len(x if within else y) < 1 + within:
            return empty
        sets, digests, out = gramsets.Sets(gramsets.as_strings(t["text"].combine_chunks())), t["digest"].combine_chunks(), [empty]
        for p, q, common in gramsets.cell_pairs(x, y, n, sets, threshold, length_ratio):
            whole = sets.size[p] + sets.size[q] - common
            out.append(pa.table([pa.repeat(t["language"][0], len(p)), digests.take(pa.array(p)), digests.take(pa.array(q)), pa.array(common.astype(np.int32)), pa.array(whole.astype(np.int32))], names=empty.schema.names))
        return pa.concat_tables(out)

    return placed.repartition(_tasks(texts), *key).groupBy(*key).applyInArrow(work, schema)


def exact_pairs(records: DataFrame, threshold: float = 0.8, length_ratio: float = 0.75) -> DataFrame:
    """(a, b, common, whole, similarity) of all similar records of a language, without a miss; a < b.

    common and whole are the trigrams in both and in either.  Different texts
    are compared once and their records joined to the similar ones; copies are
    listed pair by pair.
    """
    member = records.filter("text IS NOT NULL AND language IS NOT NULL AND id IS NOT NULL").select("id", "language", F.unhex(F.md5("text")).alias("digest"), "text")
    member_of = lambda name, digest: member.select("language", F.col("digest").alias(digest), F.col("id").alias(name))
    near = _similar_texts(_texts(records), threshold, length_ratio)
    across = near.join(member_of("x", "one"), ["language", "one"]).join(member_of("y", "two"), ["language", "two"]).filter("x != y")
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "common", "whole")
    # the trigrams of a text that has copies are counted once, not for every pair
    several = member.groupBy("language", "digest").agg(F.count("*").alias("copies"), F.first("text").alias("text")).filter("copies > 1").select("language", "digest", F.size(trigrams(F.col("text"))).alias("common"))
    copies = several.join(member_of("a", "digest"), ["language", "digest"]).join(member_of("b", "digest"), ["language", "digest"]).filter("a < b").select("a", "b", "common", F.col("common").alias("whole"))
    return across.unionByName(copies).withColumn("similarity", rounded(F.col("common") / F.col("whole")))


def exact_links(records: DataFrame, threshold: float = 0.8, length_ratio: float = 0.75) -> DataFrame:
    """(a, b) of as many of the exact pairs as join the same records: copies hang on the least of them."""
    member = records.filter("text IS NOT NULL AND language IS NOT NULL AND id IS NOT NULL").select("id", "language", F.unhex(F.md5("text")).alias("digest"))
    least = member.groupBy("language", "digest").agg(F.min("id").alias("least"))
    stars = member.join(least, ["language", "digest"]).filter("id != least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    of = lambda name, digest: least.select("language", F.col("digest").alias(digest), F.col("least").alias(name))
    near = _similar_texts(_texts(records), threshold, length_ratio).join(of("x", "one"), ["language", "one"]).join(of("y", "two"), ["language", "two"]).filter("x != y")
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(stars)


def groups(pairs: DataFrame) -> DataFrame:
    """(id, grp): connected components, named by their least id."""
    # each round is written out, so that lineage stays short and a lost executor costs a re-read
    shared_folder(pairs.sparkSession)
    keep = lambda df: df.checkpoint()
    found = keep(pairs.select("a", "b"))
    both = keep(found.select(F.col("a").alias("id"), F.col("b").alias("other")).union(found.select("b", "a")).distinct())
    labels = keep(both.groupBy("id").agg(F.least("id", F.min("other")).alias("grp")))
    while True:
        over = labels.select(F.col("id").alias("other"), F.col("grp").alias("g"))
        near = both.join(over, "other").groupBy("id").agg(F.min("g").alias("g"))
        new = labels.join(near, "id").select("id", F.least("grp", "g").alias("grp"), (F.col("g") < F.col("grp")).alias("moved"))
        new = keep(new)
        if new.filter("moved").isEmpty():
            return new.select("id", "grp")
        labels = new.select("id", "grp")


def similar_functions(descriptors: DataFrame, min_characters: int = 0, threshold: float = 0.99) -> DataFrame:
    """Duplicate groups by equal or similar normal forms, as an option beyond the dry rule.

    descriptors as for ``rules.duplicate_groups``.  Equal forms are linked
    through one of them, similar ones by their bands; a group is a connected
    component with its least confidence and the signals that made it.
    """
    from ..lex.dry import LEAST_CHARACTERS
    from ..schema import violations

    floor = F.greatest(F.lit(min_characters), F.when(F.col("language") == "shell", 0).otherwise(LEAST_CHARACTERS))
    rows = descriptors.filter(F.col("character_count") >= floor).withColumn("id", F.concat_ws("#", "path", F.col("start_line").cast("string"), "name"))
    first = rows.groupBy(F.sha2("fingerprint", 256).alias("digest")).agg(F.min("id").alias("a"))
    equal = rows.select("id", F.sha2("fingerprint", 256).alias("digest")).join(first, "digest").filter(F.col("id") != F.col("a")).select("a", F.col("id").alias("b"), F.lit(1.0).alias("confidence"), F.lit("exact-normalized").alias("signal"))
    single = rows.join(first.select(F.col("a").alias("id")), "id", "left_semi").select("id", "language", F.col("fingerprint").alias("text"))
    near = band_pairs(single, threshold).select("a", "b", F.col("similarity").alias("confidence"), F.lit("similar-normalized").alias("signal"))
    links = equal.union(near)
    member = groups(links.select("a", "b"))
    facts = links.join(member, links["a"] == member["id"]).groupBy("grp").agg(F.min("confidence").alias("confidence"), F.array_sort(F.collect_set("signal")).alias("signals"))
    each = F.struct("path", "start_line", "name", "classification", "language")
    found = rows.join(member, "id").groupBy("grp").agg(F.sort_array(F.collect_list(each)).alias("g")).join(facts, "grp")
    functions = F.transform("g", lambda m: F.struct(m["classification"].alias("classification"), m["path"].alias("filePath"), m["language"].alias("language"), m["start_line"].alias("line"), m["name"].alias("name")))
    details = {
        "confidence": F.col("confidence"), "files": F.array_sort(F.array_distinct(F.transform("g", lambda m: m["path"]))), "fixable": F.lit(False), "functions": functions,
        "locations": F.transform("g", lambda m: F.concat(m["path"], F.lit("#"), m["name"])), "signals": F.col("signals"),
    }
    return violations(found, "dry", F.lit("duplicate function group"), details, path=F.lit("multiple files"))
