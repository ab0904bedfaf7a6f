"""Near duplicates by one-permutation MinHash, banded buckets and star-shaped candidates.

1. Every text gets its set of distinct 5-word shingles (64-bit digests of lower-cased words), a
   128-bit digest of the set, and 24 band keys. Texts of equal sets form a class; only the class,
   by its smallest doc_id, goes on, so copies cost nothing further.
2. Classes that share a band key form a bucket. Each bucket proposes a star: its most popular
   member (by the sizes of its buckets) against the others, so a bucket of n gives n - 1 pairs.
3. Pairs are confirmed on the full sets and joined into components.
4. Leaves of one centre can be linked with each other without being linked with it. Such pairs are
   found exactly: leaves that share one of the rarest shingles by which they differ from the centre
   (see `_leaf_pairs`), and are confirmed too. So a link is lost only if a pair shares no band,
   never because of the choice of a centre, and no bucket is expanded into all its pairs.

Defined results: null and empty texts and those without words have empty sets and are linked with
nothing. Rows sharing a doc_id are one document. Rows with a null doc_id are not compared, have
no class and stay. Repeated rows get equal results. Extra columns pass through `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm import sketch
from cinderlog.llm.shared import aside, stored

#: Doc_ids that may be broadcast (8 bytes each) to fetch the texts of candidates.
MAX_BROADCAST = 2_000_000
#: Bytes of text that a task works on at once, unless one text is longer.
SLICE = 2 << 20


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch[0].to_pylist(), batch[1].cast(pa.binary()), strict=True):
            ids.append(i)
            texts.append(t.as_py() or b"")
            size += len(texts[-1])
            if size >= SLICE:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in _slices(batches):
        sets = sketch.shingle_sets(texts)
        digests = [sketch.digest(s) for s in sets]
        yield pa.RecordBatch.from_pydict(
            {
                "m_doc": pa.array(ids, pa.int64()),
                "m_n": pa.array([len(s) for s in sets], pa.int64()),
                "m_c1": pa.array([d[0] for d in digests], pa.int64()),
                "m_c2": pa.array([d[1] for d in digests], pa.int64()),
                "m_bands": pa.array(
                    [sketch.bands(s) if len(s) else [] for s in sets], pa.list_(pa.int64())
                ),
            }
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in _slices(batches):
        sets = [s.view("int64") for s in sketch.shingle_sets(texts)]
        yield pa.RecordBatch.from_pydict(
            {"m_doc": pa.array(ids, pa.int64()), "m_set": pa.array(sets, pa.list_(pa.int64()))}
        )


def _centres(members: DataFrame) -> DataFrame:
    """The most popular member of each bucket; a digest settles ties."""
    rank = F.col("m_fame") * 65536 + F.pmod(F.xxhash64("m_node"), F.lit(65536))
    return members.groupBy("m_key").agg(F.max_by("m_node", rank).alias("m_centre"))


def _sizes(a: str, b: str, percent: int) -> Column:
    """Sets of too different sizes cannot be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _sorted(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.greatest(a, b).alias("m_a"), F.least(a, b).alias("m_b")).distinct()


def _leaf_pairs(leaves: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of leaves of one centre that may be similar enough and aren't joined yet.

    A leaf x differs from its centre by a set dx of shingles, and two leaves from each other by
    those that only one of dx and dy holds. Similar enough means that these are at most
    (1 - t) / (1 + t) of both sizes, hence at most D = |x| (1 - t) / t. So dx and dy share all but D
    of dx, unless both are so close to the centre that it is linked with them, and with elements
    ordered from rare to frequent they share one of the first D + 1, with enough of both sets still
    to come. What a change alone brought about comes first in that order, so leaves that merely
    stem from one text hardly meet.
    """
    centre = sets.withColumnsRenamed({"m_doc": "m_centre", "m_set": "m_cs"})
    both = leaves.join(sets.withColumnRenamed("m_doc", "m_node"), "m_node").join(centre, "m_centre")
    apart = F.array_union(F.array_except("m_set", "m_cs"), F.array_except("m_cs", "m_set"))
    deltas = stored(
        both.select("m_centre", "m_node", "m_n", "m_label", F.explode(apart).alias("m_e")), "deltas"
    )
    often = deltas.groupBy("m_centre", "m_e").agg(F.count("*").alias("m_df"))
    whole = Window.partitionBy("m_centre", "m_node")
    ranked = deltas.join(often, ["m_centre", "m_e"]).withColumns(
        {
            "m_r": F.row_number().over(whole.orderBy("m_df", "m_e")),
            "m_d": F.count("*").over(whole),
        }
    )
    least = F.floor(F.col("m_n") * (100 - percent) / percent) + 1
    first = ranked.where((F.col("m_r") <= least) & (F.col("m_df") > 1))
    own = ["m_node", "m_n", "m_label", "m_r", "m_d"]
    first = stored(first.select("m_centre", "m_e", *own), "prefixes")
    met = _met(first, own)
    # From their first common element on, both must hold as many as the pair has to share.
    left = F.least(F.col("m_d") - F.col("m_r"), F.col("m_dy") - F.col("m_ry")) + 1
    apart = (F.col("m_n") + F.col("m_ny")) * (100 - percent)
    enough = (F.col("m_d") + F.col("m_dy") - left * 2) * (100 + percent) <= apart
    return _sorted(met.where(enough & _sizes("m_n", "m_ny", percent)), "m_node", "m_nodey")


def _met(first: DataFrame, own: list[str]) -> DataFrame:
    """Pairs of leaves with an element in common and different labels, once per element.

    Leaves of one label are linked already. An element whose leaves have one label is left out; of
    others the leaves outside the most frequent label meet all, so near copies by the thousand that
    share their label cost as many pairs as there are strays among them, not their square.
    """
    on = ["m_centre", "m_e"]
    labels = first.groupBy(*on, "m_label").agg(F.count("*").alias("m_many"))
    most = labels.groupBy(*on).agg(
        F.max_by("m_label", "m_many").alias("m_top"), F.count("*").alias("m_labels")
    )
    mixed = first.join(most.where("m_labels > 1").drop("m_labels"), on)
    other = mixed.where("m_label <> m_top").drop("m_top")
    other = other.withColumnsRenamed({c: f"{c}y" for c in own})
    return mixed.join(other, on).where(
        "m_label <> m_labely and (m_label = m_top or m_node < m_nodey)"
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose sets are similar enough."""
    a = sets.withColumnsRenamed({"m_doc": "m_a", "m_set": "m_sa"})
    b = sets.withColumnsRenamed({"m_doc": "m_b", "m_set": "m_sb"})
    both = pairs.join(a, "m_a").join(b, "m_b")
    both = both.select(
        "m_a",
        "m_b",
        F.size(F.array_intersect("m_sa", "m_sb")).alias("m_i"),
        (F.size("m_sa") + F.size("m_sb")).alias("m_s"),
    )
    return both.where(F.col("m_i") * 100 >= (F.col("m_s") - F.col("m_i")) * percent).select(
        "m_a", "m_b"
    )


def components(links: DataFrame, a: str = "m_a", b: str = "m_b") -> DataFrame:
    """m_node and m_label, the smallest node that can be reached from it, for all nodes of links.

    Labels spread over the links and then jump to their label's label, so the rounds grow with
    the logarithm of a component's width.
    """
    ends = links.select(F.col(a).alias("m_x"), F.col(b).alias("m_y"))
    ends = stored(ends.union(ends.select("m_y", "m_x")).distinct(), "links")
    labels = stored(
        ends.groupBy(F.col("m_x").alias("m_node")).agg(
            F.least("m_node", F.min("m_y")).alias("m_label")
        ),
        "labels",
    )
    while True:
        near = ends.join(labels.withColumnRenamed("m_node", "m_y"), "m_y").select(
            F.col("m_x").alias("m_node"), "m_label"
        )
        spread = near.union(labels).groupBy("m_node").agg(F.min("m_label").alias("m_label"))
        jump = labels.select(F.col("m_node").alias("m_label"), F.col("m_label").alias("m_jump"))
        moved = stored(
            spread.join(jump, "m_label").select("m_node", F.col("m_jump").alias("m_label")),
            "labels",
        )
        changed = moved.join(
            labels.withColumnRenamed("m_label", "m_old"), "m_node"
        ).where("m_label <> m_old")
        labels = moved
        if changed.isEmpty():
            return labels


def classes(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 80
) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of each row of df with a doc_id.

    Rows without a doc_id have no row here; `keep` keeps them. Links two documents where 100 * intersection >= percent * union of their shingle sets.
    """
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("m_doc"), F.col(f"`{text}`").alias("m_t"))
    docs = docs.where(F.col("m_doc").isNotNull())
    rows = stored(
        docs.mapInArrow(
            _sketches, "m_doc long, m_n long, m_c1 long, m_c2 long, m_bands array<long>"
        ),
        "sketches",
    )
    same = ["m_n", "m_c1", "m_c2"]
    full = rows.where("m_n > 0")
    nodes = stored(full.groupBy(*same).agg(F.min("m_doc").alias("m_node")), "classes")
    leads = full.join(nodes.withColumnRenamed("m_node", "m_doc"), [*same, "m_doc"])
    # Repeated rows would only repeat their pairs.
    keyed = leads.select(F.col("m_doc").alias("m_node"), "m_n", F.explode("m_bands").alias("m_key"))
    keys = keyed.groupBy("m_key").agg(F.count("*").alias("m_many")).where("m_many > 1")
    members = stored(keyed.join(keys, "m_key").distinct(), "members")
    fame = members.groupBy("m_node").agg(F.sum("m_many").alias("m_fame"))
    members = stored(members.join(fame, "m_node").drop("m_many"), "buckets")

    # Stars.
    centres = stored(_centres(members), "centres")
    own = members.select(
        F.col("m_node").alias("m_centre"), F.col("m_n").alias("m_cn"), "m_key"
    )
    stars = centres.join(own, ["m_key", "m_centre"]).join(members, "m_key")
    pairs = stars.where("m_node <> m_centre").where(_sizes("m_n", "m_cn", percent))
    pairs = stored(_sorted(pairs, "m_node", "m_centre"), "pairs")

    wanted = stored(members.select(F.col("m_node").alias("m_doc")).distinct(), "candidates")
    few = wanted.count() <= MAX_BROADCAST
    texts = docs.join(F.broadcast(wanted) if few else wanted, "m_doc", "left_semi")
    sets = stored(texts.mapInArrow(_sets, "m_doc long, m_set array<long>"), "sets")
    links = stored(_confirmed(pairs, sets, percent), "confirmed")
    labels = components(links)

    # What a star could not see: links between two of its leaves.
    rest = members.join(centres, "m_key").where("m_node <> m_centre")
    rest = rest.join(labels, "m_node", "left")
    rest = rest.withColumn("m_label", F.coalesce("m_label", "m_node"))
    split = rest.groupBy("m_key").agg(F.min("m_label").alias("m_lo"), F.max("m_label").alias("m_hi"))
    split = split.where("m_lo <> m_hi").select("m_key")
    leaves = rest.join(split, "m_key", "left_semi")
    leaves = stored(leaves.select("m_centre", "m_node", "m_n", "m_label").distinct(), "leaves")
    pairs = stored(_leaf_pairs(leaves, sets, percent), "leaf-pairs")
    found = stored(_confirmed(pairs, sets, percent), "confirmed")
    if not found.isEmpty():
        labels = components(links.union(found))

    out = rows.select("m_doc", *same).join(nodes, same, "left")
    return out.join(labels, "m_node", "left").select(
        F.col("m_doc").alias("doc_id"),
        F.col("m_n").alias("n_shingles"),
        F.coalesce("m_node", "m_doc").alias("class_id"),
        F.coalesce("m_label", "m_node", "m_doc").alias("component_id"),
    )


def keep(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 80
) -> DataFrame:
    """One document of each group, that with the smallest doc_id, in the columns of df."""
    plain, (t, d) = aside(df, text, doc_id)
    gone = classes(plain, t, d, percent).where("doc_id <> component_id")
    gone = stored(gone.select(F.col("doc_id").alias("m_gone")).distinct(), "gone")
    few = gone.count() <= MAX_BROADCAST
    kept = plain.join(
        F.broadcast(gone) if few else gone, F.col(d) == F.col("m_gone"), "left_anti"
    )
    return kept.toDF(*df.columns)
