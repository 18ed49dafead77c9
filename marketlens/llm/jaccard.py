"""N-gram Jaccard join by token-combination prefixes (operator 2).

A document is the set of its distinct 5-word shingles (tokens).  Tokens have
one global order: rare class first, frequent class by frequency last.  With e =
|x| - ceil(t |x|) tokens that a partner may lack, x's prefix is its first e + 1
tokens, extended by one where it reaches the frequent class.  Rare tokens of the
prefix are indexed singly, frequent ones by pairs (two-token combinations):

* the shorter of two linked documents' prefixes holds at least one shared token
  (two if extended), and all of them are in the other prefix as well;
* a shared rare token is a shared signature; otherwise two shared frequent
  tokens are one.

So every link shares a signature.  Pairs grow with the square of the prefix, so
they are used for sets of at most SHORT tokens; sets over t * SHORT index their
e + 1 tokens singly too, whatever the class, which covers pairs across that
border and above it.

The order needs a frequency estimate only, and any order is correct: counts of
2^18 hash cells (a table of fixed size) tell the frequent class.  Signatures are
counted first, and only those of two sets at least are indexed.

Groups of copies aren't expanded into all pairs.  Each bucket names a hub, found
by a grouped maximum, and each document verifies the hub that it shares most
signatures with, if these are enough to promise a link; components of these
links settle the buckets of copies.  Buckets
that still hold several components give the pairs across them; there the count
of shared signatures is exact and bounds the overlap, and what passes is
verified.  A second pass of components ends the job: links inside a component
change nothing.  Sets are rebuilt from the texts rather than stored.  Equal sets
are one node (a 64-bit fingerprint).

Cases: null text, empty text, or no words: an empty set, linked with nothing;
fewer than five words: one shingle of all words; equal rows: one node; a null
doc_id takes part and never names a component unless all its ids are null;
empty table: no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import arrow_rows, bit_table, blocks, has_bit, materialise, prepared, read_table, row_key, row_order, text_bytes, whole_row
from marketlens.llm.components import connected_components
from marketlens.llm.shingles import mix, shingle_sets

WIDTH = 5
#: Similarity in hundredths.
PERCENT = 75
CELL_BITS = 18
#: Members from which a bucket is large, and the largest set whose rows carry
#: its signatures of large buckets.
LARGE, CARRIED = 64, 1000
#: Rounds in which each node tries its likeliest pair only.
STARS = 1
#: Largest set that indexes pairs of frequent tokens.
SHORT = 120


def _fingerprint(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64 bits of each set; 0 for an empty one."""
    n = np.diff(off)
    sums = np.zeros(len(s) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(s), out=sums[1:])
        out = mix(sums[off[1:]] - sums[off[:-1]] + n.astype(np.uint64))
    out[n == 0] = 0
    return out


def _sets(column: pa.Array):
    """(first row, last row, shingles, offsets, fingerprints) for each block of
    a text column."""
    buf, off = text_bytes(column)
    for lo, hi in blocks(off):
        s, at = shingle_sets(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], WIDTH)
        yield lo, hi, s, at, _fingerprint(s, at)


def _profile(keyed: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Row key, set size and fingerprint of every row, and the cell counts.
    One pass gives both: cell rows have a null key column."""

    def run(batches):
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for b in arrow_rows(batches):
            for lo, hi, s, at, fp in _sets(b.column(1)):
                cells += np.bincount((s >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), pa.array(fp.view(np.int64)), pa.nulls(hi - lo, pa.int32())],
                    ["key", "doc_id", "n", "node", "cell"],
                )
        full = np.flatnonzero(cells)
        if len(full):
            none = pa.nulls(len(full), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.nulls(len(full), id_type), pa.array(cells[full]), none, pa.array(full, pa.int32())], ["key", "doc_id", "n", "node", "cell"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = keyed.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    both = materialise(keyed.select("key", "text", "doc_id").mapInArrow(run, f"key long, doc_id {kind.simpleString()}, n long, node long, cell int"), "jaccard-profile")
    counts = np.zeros(1 << CELL_BITS, np.int64)
    cells = both.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 2^CELL_BITS rows at most
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return both.where("cell is null").select("key", "doc_id", "n", "node"), counts


def _excess(counts: np.ndarray) -> np.ndarray:
    """Estimated documents of a cell's frequent token; 0: the rare class."""
    usual = float(np.median(counts))
    over = counts - usual
    return np.where(over >= max(64.0, 6 * np.sqrt(usual)), over, 0).astype(np.int64)


def _signatures(s: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, int]:
    """Signatures of one set, and how many of them, the last ones, are of the
    scheme of single tokens."""
    n = len(s)
    e = n - -(-PERCENT * n // 100)
    if level.any():
        order = np.argsort(level, kind="stable")[: e + 2]
        s, level = s[order], level[order]
    else:
        s, level = s[: e + 2], level[: e + 2]
    sig, singles = [], 0
    with np.errstate(over="ignore"):
        if n <= SHORT:
            rare = level == 0
            if rare[min(e, n - 1)]:  # the whole prefix is of the rare class
                sig.append(mix(s[: e + 1] + np.uint64(1)))
            else:
                t = s[~rare]
                i, j = np.triu_indices(len(t), 1)
                sig += [mix(s[rare] + np.uint64(1)), mix(mix(t[i] + np.uint64(2)) + t[j])]
        if n * 100 > PERCENT * SHORT:
            sig.append(mix(s[: e + 1] + np.uint64(3)))
            singles = e + 1
    return np.concatenate(sig), singles


def _shared(keyed: DataFrame, level) -> DataFrame:
    """Signatures (column sig) of at least two tasks' or blocks' sets."""

    def run(batches):
        seen: set[int] = set()
        for sig, *_ in _signed(batches, level.value, seen):
            u, n = np.unique(sig.view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["sig", "n"])

    n = keyed.select("text").mapInArrow(run, "sig long, n long").groupBy("sig").agg(F.sum("n").alias("n"))
    return materialise(n.where("n > 1").select("sig"), "jaccard-shared")


def _index(keyed: DataFrame, level) -> DataFrame:
    """sig, single, node, n, degree for the shared signatures of every distinct
    set (and a few more that their bit table lets pass); degree: how many of
    them the set has."""
    cast = keyed.sparkSession.sparkContext.broadcast(bit_table(_shared(keyed, level), "sig"))

    def run(batches):
        seen: set[int] = set()
        for sig, single, node, size in _signed(batches, level.value, seen):
            keep = has_bit(cast.value, sig)
            sig, single, node, size = sig[keep], single[keep], node[keep], size[keep]
            _, own, many = np.unique(node, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(single), pa.array(node.view(np.int64)), pa.array(size), pa.array(many[own].astype(np.int32))], ["sig", "single", "node", "n", "degree"])

    return keyed.select("text").mapInArrow(run, "sig long, single boolean, node long, n int, degree int")


def _signed(batches, level_of: np.ndarray, seen: set[int]):
    """Signatures of a task's distinct sets, a block at a time, with whether
    they are of the single scheme, the node and its set size."""
    for b in arrow_rows(batches):
        for lo, hi, s, at, fp in _sets(b.column(0)):
            level = level_of[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
            sigs, nodes = [], []
            for k in range(hi - lo):
                node, i, j = int(fp[k]), at[k], at[k + 1]
                if i == j or node in seen:  # the task has shown this set
                    continue
                seen.add(node)
                sig, singles = _signatures(s[i:j], level[i:j])
                sigs.append(sig)
                nodes.append((len(sig), node, j - i, singles))
            if not sigs:
                continue
            sig = np.concatenate(sigs)
            times = np.array([x[0] for x in nodes])
            node = np.repeat(np.array([x[1] for x in nodes], np.uint64), times)
            size = np.repeat(np.array([x[2] for x in nodes], np.int32), times)
            from_end = np.repeat(np.cumsum(times), times) - np.arange(len(sig))
            single = from_end <= np.repeat(np.array([x[3] for x in nodes]), times)
            yield sig, single, node, size


def _candidate_sets(keyed: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, tokens for every node of ``nodes`` (column node), from the texts
    of a row each.
    A bit table of bounded size drops most other documents before the join."""
    keys = materialise(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key")), "jaccard-keys")
    cast = keyed.sparkSession.sparkContext.broadcast(bit_table(keys, "key"))

    def run(batches):
        seen = set()
        for b in arrow_rows(batches):
            b = b.filter(pa.array(has_bit(cast.value, b.column(1).to_numpy().view(np.uint64))))
            for _, _, s, at, fp in _sets(b.column(0)):
                rows = [k for k in range(len(fp)) if at[k + 1] > at[k] and not (int(fp[k]) in seen or seen.add(int(fp[k])))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(fp[rows].view(np.int64)), pa.array([s[at[k] : at[k + 1]].view(np.int64) for k in rows], pa.list_(pa.int64()))], ["node", "tokens"])

    found = keyed.select("text", "key").mapInArrow(run, "node long, tokens array<long>").join(nodes, "node", "left_semi")
    return materialise(found.dropDuplicates(["node"]), "jaccard-sets")


def _sets_of(pairs: DataFrame, keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """The sets of the nodes of pairs (a, b)."""
    return _candidate_sets(keyed, rows, materialise(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "jaccard-nodes"))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that reach the similarity."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("tokens").alias(f"{c}_tokens"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    both = both.select("a", "b", shared.alias("i"), (F.size("a_tokens") + F.size("b_tokens")).alias("n"))
    return both.where(f"100L * i >= {PERCENT}L * (n - i)").select("a", "b")


def _pairs_across(left: DataFrame) -> DataFrame:
    """Pairs of nodes of one bucket and different roots: a, a_n, b, b_n, c
    (shared signatures of the single scheme), pairs (whether they share one of
    another).  ``left``: sig, single, node, n, root of the open buckets.

    A pair of a large bucket usually shares many, so there it is made at the
    first of them only, and only if all that it may share is enough; rows carry
    the node's signatures of large buckets for that (sets up to CARRIED)."""
    large = left.where("single").groupBy("sig").count().where(f"count >= {LARGE}").select("sig", F.lit(True).alias("large"))
    rows = left.join(large, "sig", "left").withColumn("carried", F.coalesce("large", F.lit(False)) & F.col("single") & (F.col("n") <= CARRIED))
    rows = materialise(rows.select("sig", "single", "node", "n", "root", "carried"), "jaccard-rows")
    across = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    across = across & (100 * F.least("x.n", "y.n") >= PERCENT * F.greatest("x.n", "y.n"))
    named = ["x.node as a", "x.n as a_n", "y.node as b", "y.n as b_n"]
    plain = rows.alias("x").join(rows.alias("y"), across & ~(F.col("x.carried") & F.col("y.carried")))
    plain = plain.selectExpr(*named, "if(x.single, 1L, 0L) as c", "not x.single as pairs")

    carried = rows.where("carried")
    own = carried.groupBy("node").agg(F.sort_array(F.collect_set("sig")).alias("own"))
    others = rows.where("single and not carried").groupBy("node").agg(F.count("*").alias("others"))
    carried = carried.join(own.join(others, "node", "left").select("node", "own", F.coalesce("others", F.lit(0)).alias("others")), "node")
    both = F.array_intersect("x.own", "y.own")
    most = F.size(both) + F.least("x.others", "y.others")  # what they share is in open buckets
    enough = most + F.expr(_rest("x.n", "y.n")) >= F.expr(_need("x.n", "y.n"))
    once = carried.alias("x").join(carried.alias("y"), across & (F.col("x.sig") == F.array_min(both)) & enough)
    once = once.select(*[F.expr(e) for e in named], F.size(both).cast("long").alias("c"), F.lit(False).alias("pairs"))
    return plain.union(once).groupBy("a", "a_n", "b", "b_n").agg(F.sum("c").alias("c"), F.max("pairs").alias("pairs"))


def _rest(a: str, b: str) -> str:
    """SQL: what the larger of two sets holds beyond its prefix."""
    return f"(({PERCENT}L * greatest({a}, {b}) + 99) div 100 - 1)"


def _need(a: str, b: str) -> str:
    """SQL: tokens that sets of two sizes have to share."""
    return f"(({PERCENT}L * ({a} + {b}) + {99 + PERCENT}) div {100 + PERCENT})"


def _hopeful() -> str:
    """SQL: whether sets of a_n and b_n tokens can reach the similarity.  If
    both index their prefix singly, c shared signatures leave at most c plus the
    larger rest to share; pairs of tokens don't bound it."""
    sizes = f"100L * least(a_n, b_n) >= {PERCENT}L * greatest(a_n, b_n)"
    single = f"100L * least(a_n, b_n) > {PERCENT * SHORT}L"
    return f"{sizes} and case when {single} then c + {_rest('a_n', 'b_n')} >= {_need('a_n', 'b_n')} else pairs or c > 0 end"


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: key (see ``row_key``), doc_id, n_shingles,
    component_id, component (the group's own 64 bits; a set of its own for an
    empty row)."""
    prepared(docs)
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    keyed = src.withColumn("key", row_key())
    rows, counts = _profile(keyed)
    level = docs.sparkSession.sparkContext.broadcast(_excess(counts))  # 2^CELL_BITS numbers

    # each bucket's star: from the member that shares most signatures in all, as the original of copies does
    members = materialise(_index(keyed, level), "jaccard-members")
    hubs = members.groupBy("sig").agg(F.max(F.struct("degree", "node", "n")).alias("hub"))
    stars = members.join(hubs, "sig").selectExpr("node as a", "n as a_n", "hub.node as b", "hub.n as b_n", "single")
    stars = stars.where("a <> b").groupBy("a", "a_n", "b", "b_n").agg(F.count(F.when(F.col("single"), 1)).alias("c"), F.max(~F.col("single")).alias("pairs"))
    best = stars.where(_hopeful()).groupBy("a").agg(F.max(F.struct("c", "b")).alias("best")).selectExpr("a", "best.b as b")
    best = materialise(best, "jaccard-pairs")
    links = materialise(_verify(best, _sets_of(best, keyed, rows)), "jaccard-links")
    labels = connected_components(links)

    # buckets that still hold several components: pairs across them, with all the signatures that they share
    held = members.join(labels, "node", "left").select("sig", "single", "node", "n", F.coalesce("root", "node").alias("root"))
    open_ = held.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("sig")
    left = materialise(held.join(open_, "sig", "left_semi").distinct(), "jaccard-open")
    pairs = _pairs_across(left).where(_hopeful()).select("a", "b", "c")
    pairs = materialise(pairs, "jaccard-pairs")
    sets = _sets_of(pairs, keyed, rows)
    for again in range(STARS + 1):  # each node's likeliest pair first, which settles most others; then all that are left
        if pairs.isEmpty():
            break
        tried = pairs.groupBy("a").agg(F.max(F.struct("c", "b")).alias("best")).selectExpr("a", "best.b as b") if again < STARS else pairs.select("a", "b")
        tried = materialise(tried, "jaccard-tried")
        links = links.union(materialise(_verify(tried, sets), "jaccard-links"))
        labels = connected_components(links)
        root = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        left = pairs.join(tried, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
        pairs = materialise(left.where("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b", "c"), "jaccard-pairs")

    placed = rows.join(labels, "node", "left").select("key", "doc_id", "n", F.coalesce("root", "node").alias("component"))
    ids = placed.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("first_id"))
    out = placed.join(ids, "component", "left")
    own = F.when(F.col("n") > 0, F.col("first_id")).otherwise(F.col("doc_id"))
    return out.select("key", "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each group: the one of the
    least id (nulls last).  Rows without words stay."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), whole_row(docs).alias("row"), row_order(docs).alias("order")).withColumn("key", row_key())
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    first = link(docs, id_col, text_col).where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    once = rows.where(worded).join(first.select("first.key"), "key", "left_semi").groupBy("key").agg(F.min_by("row", "order").alias("row"))
    return once.select("row").union(rows.where(~worded).select("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
