"""Near-duplicate groups with bottom-k sketches of one hash function.

Rows with equal shingle sets fall together first, so copies cost one row each.
Every distinct set keeps its ``SKETCH`` smallest hashes. Two sets whose union
sketch can reach the least estimate share a retained value among the rarest
few of each, so only those values make inverted lists: boilerplate is never
among the rarest. A list is handled as a star around its least member, not as
pairs. Spokes with a high enough estimate are confirmed on full sets; members
that are left outside their star's component are compared with the rest of the
star in blocks of bounded size, again first by sketch, then on full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, steps, text_bytes, text_column, tidy
from .components import components
from .words import shingles

SKETCH = 64
#: How far an estimate may lie below the threshold and still lead to a full comparison: 4.5 standard deviations of 64 values at 0.85.
SLACK = 0.2
BLOCK = 512
COLUMNS = 2048


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, set_hash, sketch) of every row of docs (doc_id, text)."""
    schema = "doc_id long, n long, set_hash binary, sketch array<long>"

    def run(batches):
        for batch in steps(batches):
            sets = shingles(*text_bytes(batch.column("text")), width)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([s[:SKETCH] for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "set_hash", "sketch"],
            )

    return text_column(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, schema)


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left sets with the right ones, by products of 0/1 matrices a few columns wide."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, code, count = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    rows, code = rows[count[code] > 1], number[code[count[code] > 1]]
    order = np.argsort(code, kind="stable")
    rows, code = rows[order], code[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, (low, low + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[rows[a:b], code[a:b] - low] = 1
        out += m[left] @ m[right].T
    return out


def _estimates(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, share: float) -> np.ndarray:
    """Pairs (i, j) of left and right whose union sketch estimates a similarity of ``share`` or more."""
    sizes = np.array([len(s) for s in sets])
    over = _overlaps(sets, left, right)
    i, j = np.nonzero(over >= share * np.minimum(sizes[left][:, None], sizes[right][None, :]))
    keep = []
    padded = np.full((len(sets), SKETCH), np.iinfo(np.int64).max)
    for k, s in enumerate(sets):
        padded[k, : len(s)] = s
    for low in range(0, len(i), 4096):
        both = np.sort(np.concatenate((padded[left[i[low : low + 4096]]], padded[right[j[low : low + 4096]]]), 1), 1)
        real = both < np.iinfo(np.int64).max
        twin = np.zeros(both.shape, bool)
        twin[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
        rank = np.cumsum(real & ~twin, 1)
        union = np.minimum(rank[:, -1], SKETCH)
        keep.append((twin & (rank <= union[:, None])).sum(1) >= share * union)
    return np.stack((i, j))[:, np.concatenate(keep)] if keep else np.zeros((2, 0), int)


def _spanning(left, right, comps: np.ndarray, nodes: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    """Links among hits that join two components not joined by a link before."""
    at = {c: c for c in comps.tolist()}

    def root(x):
        while at[x] != x:
            at[x] = x = at[at[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(hit), strict=True):
        x, y = root(comps[left[i]].item()), root(comps[right[j]].item())
        if x != y:
            at[max(x, y)] = min(x, y)
            out.append((int(nodes[left[i]]), int(nodes[right[j]])))
    return out


def _block(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return pdf.node.to_numpy(), pdf.comp.to_numpy(), np.flatnonzero(pdf.on_left), np.flatnonzero(pdf.on_right)


def _likely(share: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of a block that are in a likely link between two components."""
        nodes, comps, left, right = _block(pdf)
        i, j = _estimates(list(pdf.sketch), left, right, share)
        apart = comps[left[i]] != comps[right[j]]
        out = pd.DataFrame({"star": key[0], "bi": key[1], "bj": key[2], "node": nodes, "comp": comps, "on_left": False, "on_right": False})
        out.loc[left[i[apart]], "on_left"] = True
        out.loc[right[j[apart]], "on_right"] = True
        return out[out.on_left | out.on_right]

    return run


def _confirm(width: int, percent: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of a block on full sets, as many as join its components."""
        nodes, comps, left, right = _block(pdf)
        whole = pa.RecordBatch.from_arrays([pa.array(pdf.text, pa.large_string())], ["text"])
        sets = [s for part in steps([whole]) for s in shingles(*text_bytes(part.column("text")), width)]
        sizes = np.array([len(s) for s in sets], np.int64)
        both = np.rint(_overlaps(sets, left, right)).astype(np.int64)
        union = sizes[left][:, None] + sizes[right][None, :] - both
        hit = (100 * both >= percent * union) & (union > 0) & (comps[left][:, None] != comps[right][None, :])
        return pd.DataFrame(_spanning(left, right, comps, nodes, hit), columns=["a", "b"], dtype="int64")

    return run


def _links(blocks: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) of blocks (star, bi, bj, node, comp, on_left, on_right)."""
    schema = "star long, bi int, bj int, node long, comp long, on_left boolean, on_right boolean"
    share = percent / 100 - SLACK
    # the same kind of join at every size, so that what is shuffled follows the input
    with_sketch = blocks.join(reps.select("node", "sketch").hint("merge"), "node")
    likely = materialize(with_sketch.groupBy("star", "bi", "bj").applyInPandas(_likely(share), schema))
    with_text = likely.join(texts.hint("merge"), "node")
    return materialize(with_text.groupBy("star", "bi", "bj").applyInPandas(_confirm(width, percent), "a long, b long"))


def _block_of(node, n):
    """Block number of a node: a hash, so that no count of a group is needed to deal it out evenly."""
    return F.pmod(F.xxhash64(node), n).cast("int")


@tidy
def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text, …).

    Two documents are linked if 100 * |A ∩ B| >= percent * |A ∪ B| for their
    sets of ``width``-word shingles; component_id is the least doc_id that links
    reach. Null and empty texts have an empty set and no link. Rows that share a
    doc_id count as one document. Rows with a null doc_id are linked with
    nothing, kept, and have a null component_id. Very long texts are a step of
    their own. Other columns are ignored. An empty table gives an empty result.
    """
    sk = materialize(sketches(docs, width))
    least = sk.where("n > 0 and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("node"))
    least = materialize(least)
    reps = materialize(sk.join(least, (sk.set_hash == least.set_hash) & (sk.doc_id == least.node)).select("node", "sketch"))
    # inverted lists of the rarest retained values
    share = percent / 100 - SLACK
    postings = reps.select("node", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    lengths = postings.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    common = postings.join(lengths, "value").groupBy("node").agg(F.first("s").alias("s"), F.sort_array(F.collect_list(F.struct("n", "value"))).alias("v"))
    prefix = F.col("s") - F.ceil(F.col("s") * share) + 1 - (F.col("s") - F.size("v"))  # values in one list only come first and match nothing
    lists = materialize(common.where(prefix > 0).select("node", F.explode(F.slice("v", F.lit(1), prefix.cast("int"))).alias("v")).select("node", F.col("v.value").alias("value")))
    centres = lists.groupBy("value").agg(F.min("node").alias("star"))
    spokes = materialize(lists.join(centres, "value").where("node > star").select("star", "node").distinct())
    members = spokes.unionByName(spokes.select("star", F.col("star").alias("node")).distinct())
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    texts = materialize(text_column(docs, F.col("doc_id").cast("long").alias("doc_id")).join(wanted.hint("merge"), "doc_id", "left_semi").withColumnRenamed("doc_id", "node"))
    # spokes: the centre against blocks of its star
    counts = spokes.groupBy("star").agg((F.floor(F.count("*") / BLOCK) + 1).cast("int").alias("nb"))
    tips = spokes.join(counts, "star").select("star", F.lit(0).alias("bi"), _block_of(F.col("node"), F.col("nb")).alias("bj"), "node", F.col("node").alias("comp"), F.lit(False).alias("on_left"), F.lit(True).alias("on_right"))
    hubs = counts.select("star", F.lit(0).alias("bi"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bj"), F.col("star").alias("node"), F.col("star").alias("comp"), F.lit(True).alias("on_left"), F.lit(False).alias("on_right"))
    first = _links(tips.unionByName(hubs), reps, texts, width, percent)
    # members outside the component of their centre, against the whole star
    labels = materialize(components(first))
    placed = members.join(labels, "node", "left").select("star", "node", F.coalesce("label", "node").alias("comp"))
    hub = placed.where("star = node").select("star", F.col("comp").alias("hub"))
    placed = materialize(placed.join(hub, "star").withColumn("out", F.col("comp") != F.col("hub")))
    todo = placed.groupBy("star").agg(F.count("*").alias("m"), F.count_if("out").alias("k")).where("k > 0 and m > 2")
    todo = todo.select("star", (F.floor(F.col("m") / BLOCK) + 1).cast("int").alias("nr"), (F.floor(F.col("k") / BLOCK) + 1).cast("int").alias("nl"))
    rest = placed.join(todo, "star").repartition("star", "node")  # members of a large star meet in no task before they are dealt to blocks
    right = rest.select("star", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("bi"), _block_of(F.col("node"), F.col("nr")).alias("bj"), "node", "comp", F.lit(False).alias("on_left"), F.lit(True).alias("on_right"))
    left = rest.where("out").select("star", _block_of(F.col("node"), F.col("nl")).alias("bi"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("bj"), "node", "comp", F.lit(True).alias("on_left"), F.lit(False).alias("on_right"))
    merged = left.unionByName(right).groupBy("star", "bi", "bj", "node", "comp").agg(F.bool_or("on_left").alias("on_left"), F.bool_or("on_right").alias("on_right"))
    second = _links(merged, reps, texts, width, percent)
    final = materialize(components(first.unionByName(second)))
    # labels back to rows: set -> node -> component
    found = least.join(final, "node", "left").select("set_hash", F.coalesce("label", "node").alias("component"))
    rows = sk.select("doc_id", "n", "set_hash")
    linked = rows.where("n > 0 and doc_id is not null").join(found, "set_hash").select("doc_id", "n", "component")
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
