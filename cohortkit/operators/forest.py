"""Random forest regression (B1) whose trees grow inside tasks, not by a pass over the rows for every batch of nodes.

The forest is that of Spark's ``RandomForestRegressor``: its candidate splits, its bootstrap
draws (the same stream for each partition), variance gain, first of the best splits, same
stopping rules. Bin counts are sums over rows, so with labels whose sums are exact (scores) each
tree is the same; only the way there differs:

1. every row becomes its bins, its label and its number of draws per tree. Rows are dealt by
   their bins and sorted, so that rows of equal bins lie next to each other and are summed
   before they travel on (as many as there are, the method does not need any);
2. each tree's rows go to one task as blocks of numbers, where the tree is grown level by
   level. Only rows and finished trees travel: no bin counts of small nodes, which are the
   most by far;
3. a node of more than ``LOCAL_ROWS`` rows is too large for a task: its bin counts are summed
   over all tasks, it is split on the driver, and so on down until every node fits. So a
   task's memory depends on ``LOCAL_ROWS``, not on the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.session import materialise

LOCAL_ROWS = 1_000_000   # most rows of a node that one task takes
CHUNK_ROWS = 20_000      # rows whose draws are summed at a time
LEVEL_CELLS = 1_000_000  # bin counts of one feature that a task holds at a time
EPSILON = 2.220446049250313e-16
LEAF = -1
_BLOCK = "tree int, node int, bins binary, sums binary"
_TREE = "tree int, node int, feature binary, split binary, left binary, value binary"
_TREE_ARRAYS, _NODE = ("feature", "split", "left", "value"), ("i4", "i4", "i4", "f8")


def _ship_by_value() -> None:
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()


class Bins:
    """Candidate splits of each feature: thresholds of a continuous one (a value up to the i-th
    is in bin i), the number of categories of another, whose values are their own bins."""

    def __init__(self, thresholds: list[np.ndarray | None], arity: list[int]):
        self.thresholds = thresholds
        self.count = [a if t is None else len(t) + 1 for t, a in zip(thresholds, arity)]
        self.start = np.concatenate([[0], np.cumsum(self.count)]).astype(int)
        self.kind = np.dtype("u1" if max(self.count, default=1) <= 256 else "<u4")

    def of(self, x: np.ndarray) -> np.ndarray:
        cols = [x[:, f] if t is None else np.searchsorted(t, x[:, f]) for f, t in enumerate(self.thresholds)]
        return np.column_stack(cols).astype(self.kind) if cols else np.zeros((len(x), 0), self.kind)


def _scala(spark, name: str):
    """A singleton of Spark ML's own code."""
    return getattr(getattr(spark.sparkContext._jvm, f"org.apache.spark.ml.{name}$"), "MODULE$")


def _candidates(est: RandomForestRegressor, x: DataFrame) -> Bins:
    """The estimator's own candidate splits over ``x``."""
    spark = x.sparkSession
    jvm = spark.sparkContext._jvm
    est._transfer_params_to_java()
    jest, jdf = est._java_obj, x._jdf
    categorical = _scala(spark, "util.MetadataUtils").getCategoricalFeatures(jdf.schema().apply(est.getFeaturesCol()))
    strategy = jest.getOldStrategy(categorical, 0, jvm.org.apache.spark.mllib.tree.configuration.Algo.Regression(),
                                   jest.getOldImpurity())
    rows = _scala(spark, "util.DatasetUtils").extractInstances(jest, jdf, jvm.scala.Option.apply(None))
    meta = _scala(spark, "tree.impl.DecisionTreeMetadata").buildMetadata(rows, strategy, est.getNumTrees(),
                                                                         est.getFeatureSubsetStrategy())
    found = _scala(spark, "tree.impl.RandomForest").findSplits(rows, meta, est.getSeed())
    thresholds, arity = [], []
    for f in range(meta.numFeatures()):
        continuous = meta.isContinuous(f)
        thresholds.append(np.array([s.threshold() for s in found[f]], dtype=float) if continuous else None)
        arity.append(0 if continuous else int(meta.featureArity().apply(f)))
        if arity[-1] > 2:
            raise ValueError(f"feature {f} has {arity[-1]} categories: one-hot columns are expected")
    return Bins(thresholds, arity)


def _drawn(est: RandomForestRegressor, x: DataFrame, bins: Bins) -> DataFrame:
    """(bins, label, draws): a row's bins and how often each tree drew it. The draws are the
    estimator's, partition by partition; a bagged row comes as Java writes it, of which the packed
    row and after it the counts (big-endian) are taken."""
    spark, trees, width = x.sparkSession, est.getNumTrees(), len(bins.count) * bins.kind.itemsize
    jvm = spark.sparkContext._jvm

    def pack(batches):
        for b in batches:
            values = b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            label = b.column("label").to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, 1)
            raw = np.hstack([bins.of(values).view("u1").reshape(b.num_rows, -1), label.view("u1")])
            yield pa.record_batch({"value": _fixed(raw)})

    def unpack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            raw = _bytes(b.column("value"))
            # an array is its description (19 bytes), its length (4) and its values; zeros may follow
            start = bytes(raw[0]).find(b"ur\x00\x02[B") + 23
            label = start + width
            counts = raw[:, label + 31:label + 31 + 4 * trees].copy().view(">i4")
            if bytes(raw[0, label + 8:label + 14]) != b"ur\x00\x02[I" or counts.shape[1] != trees or counts.max() > 255:
                raise ValueError("a bagged row is not as expected")
            yield pa.record_batch({"bins": _fixed(raw[:, start:label]), "draws": _fixed(counts.astype("u1")),
                                   "label": pa.array(raw[:, label:label + 8].copy().view("<f8")[:, 0])})

    packed = x.select(vector_to_array(F.col(est.getFeaturesCol())).alias("f"), F.col(est.getLabelCol()).alias("label")) \
        .mapInArrow(pack, "value binary")
    encoders = jvm.org.apache.spark.sql.Encoders
    rdd = getattr(packed._jdf, "as")(encoders.BINARY()).rdd()
    bagging = _scala(spark, "tree.impl.BaggedPoint")
    bagged = bagging.convertToBaggedRDD(rdd, est.getSubsamplingRate(), trees, est.getBootstrap(),
                                        getattr(bagging, "convertToBaggedRDD$default$5")(), est.getSeed())
    kind = jvm.java.lang.Class.forName("org.apache.spark.ml.tree.impl.BaggedPoint")
    raw = DataFrame(spark._jsparkSession.createDataset(bagged, encoders.javaSerialization(kind)).toDF(), spark)
    return raw.mapInArrow(unpack, "bins binary, draws binary, label double")


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    ends = np.arange(len(rows) + 1, dtype="i4") * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column: pa.Array) -> np.ndarray:
    """A binary column of one width as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(len(column), -1)


def _chunks(batches, bins: Bins):
    """(bins, draws, draws x label, draws x label squared) of ``CHUNK_ROWS`` rows at a time, rows
    of equal bins that lie next to each other summed."""
    def summed(held):
        b = np.vstack([h[0] for h in held])
        y = np.concatenate([h[1] for h in held])[:, None]
        w = np.vstack([h[2] for h in held]).astype(float)
        first = np.flatnonzero(np.append(True, (b[1:] != b[:-1]).any(axis=1)))
        return b[first], *(np.add.reduceat(v, first, axis=0) for v in (w, w * y, w * (y * y)))

    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            part = batch.slice(at, CHUNK_ROWS)
            raw = _bytes(part.column("bins")).copy()
            held.append((raw.view(bins.kind).reshape(part.num_rows, -1), part.column("label").to_numpy(),
                         _bytes(part.column("draws"))))
            n += part.num_rows
            if n >= CHUNK_ROWS:
                yield summed(held)
                held, n = [], 0
    if n:
        yield summed(held)


def _variance(c, s, q):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(c == 0, 0.0, (q - s * s / c) / c)


def _best_splits(total, counts, bins: Bins):
    """For nodes with the sums ``total`` (3 x nodes): (gain, feature, bin, sums of the lower bins)
    of the first best split. ``counts(f)`` gives the sums of a feature's bins (3 x nodes x bins)."""
    nodes = total.shape[1]
    gain, feature, split = np.full(nodes, -np.inf), np.zeros(nodes, "i4"), np.zeros(nodes, "i4")
    lower = np.zeros((3, nodes))
    impurity = _variance(*total)[:, None]
    at = np.arange(nodes)
    for f, n in enumerate(bins.count):
        if n < 2:
            continue
        # categories of 0 and 1 only: more than two would have to be put in order first
        below = np.cumsum(counts(f), axis=2)[:, :, :-1]
        above = total[:, :, None] - below
        one, two = below, above
        if bins.thresholds[f] is None:
            with np.errstate(divide="ignore", invalid="ignore"):
                mean = [np.where(v[0] == 0, np.finfo(float).max, v[1] / v[0]) for v in (below, above)]
            turned = mean[1] < mean[0]
            one, two = np.where(turned, above, below), np.where(turned, below, above)
        n_one, n_two = one[0], two[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            g = impurity - n_one / (n_one + n_two) * _variance(*one) - n_two / (n_one + n_two) * _variance(*two)
        g = np.where((n_one < 1) | (n_two < 1) | (np.abs(impurity) < EPSILON) | ~(g >= 0), -np.inf, g)
        s = g.argmax(axis=1)
        better = g[at, s] > gain
        gain = np.where(better, g[at, s], gain)
        feature[better], split[better] = f, s[better]
        lower[:, better] = below[:, at, s][:, better]
    return gain, feature, split, lower


def _mean(c, s):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(c == 0, 0.0, s / c)


def _level_splits(node: np.ndarray, columns: list[np.ndarray], sums: np.ndarray, total: np.ndarray, bins: Bins):
    """``_best_splits`` of a level's nodes, as many nodes at a time as ``LEVEL_CELLS`` allows."""
    n, step = total.shape[1], max(1, LEVEL_CELLS // max(bins.count))
    order = np.argsort(node, kind="stable") if n > step else None
    found = []
    for a in range(0, n, step):
        size = min(step, n - a)
        of = slice(None) if order is None else order[slice(*np.searchsorted(node, [a, a + size], sorter=order))]
        here, part = node[of] - a, sums[:, of]

        def counts(f, here=here, part=part, of=of, size=size):
            place = here * bins.count[f] + columns[f][of]
            return np.stack([np.bincount(place, v, size * bins.count[f]).reshape(size, -1) for v in part])

        found.append(_best_splits(total[:, a:a + size], counts, bins))
    return tuple(np.concatenate(v, axis=-1) for v in zip(*found))


def _grown(rows: np.ndarray, sums: np.ndarray, bins: Bins, depth: int) -> tuple[np.ndarray, ...]:
    """The subtree over rows of bins with ``sums`` (3 x rows), of at most ``depth`` levels below its
    root: (feature, bin, left child, value) of its nodes. A right child follows the left one."""
    nodes: list[tuple[np.ndarray, ...]] = []
    columns = [np.ascontiguousarray(rows[:, f]) for f in range(rows.shape[1])]
    node, total, made = np.zeros(len(rows), "i8"), sums.sum(axis=1)[:, None], 1
    for level in range(depth + 1):
        n = total.shape[1]
        if not n:
            break
        if level < depth:
            gain, feature, split, lower = _level_splits(node, columns, sums, total, bins)
        else:
            gain, feature, split, lower = np.full(n, -np.inf), np.zeros(n, "i4"), np.zeros(n, "i4"), total
        parted = gain > 0
        rank = np.cumsum(parted) - 1
        nodes.append((np.where(parted, feature, LEAF), split, np.where(parted, made + 2 * rank, 0), _mean(*total[:2])))
        # the next level: both children of every node that is parted, and the rows that can be parted again
        total = np.stack([lower[:, parted], (total - lower)[:, parted]], axis=2).reshape(3, -1)
        made += total.shape[1]
        right = np.zeros(len(node), "i8")
        for f in np.unique(feature[parted]):
            of = feature[node] == f
            right[of] = columns[f][of] > split[node[of]]
        keep = parted[node]
        node = 2 * rank[node] + right
        keep[keep] = np.abs(_variance(*total))[node[keep]] >= EPSILON
        columns, sums, node = [c[keep] for c in columns], sums[:, keep], node[keep]
    return tuple(np.concatenate(v).astype(k) for v, k in zip(zip(*nodes), _NODE))


class _Top:
    """The upper part of a tree, split on the driver. Open nodes are grown in tasks."""

    def __init__(self):
        self.feature, self.split, self.left, self.value, self.level, self.open = [LEAF], [0], [0], [0.0], [0], [True]

    def part(self, at: int, feature: int, split: int, values) -> int:
        self.feature[at], self.split[at], self.left[at], self.open[at] = feature, split, len(self.feature), False
        for v in values:
            for a, new in ((self.feature, LEAF), (self.split, 0), (self.left, 0), (self.value, v),
                           (self.level, self.level[at] + 1), (self.open, True)):
                a.append(new)
        return self.left[at]

    def reached(self, rows: np.ndarray) -> np.ndarray:
        return _walked(rows, *(np.array(a) for a in (self.feature, self.split, self.left)))


def _walked(rows: np.ndarray, feature: np.ndarray, split: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf that each row of bins ends in."""
    node, at = np.zeros(len(rows), "i8"), np.arange(len(rows))
    while len(at := at[feature[node[at]] != LEAF]):
        n = node[at]
        node[at] = left[n] + (rows[at, feature[n]] > split[n])
    return node


def _upper(drawn: DataFrame, bins: Bins, trees: int, depth: int, rows: int) -> list[_Top]:
    """Trees split from the top until no node that can be split has more than ``LOCAL_ROWS`` rows."""
    tops = [_Top() for _ in range(trees)]
    large = [(t, 0) for t in range(trees)] if rows > LOCAL_ROWS and depth > 0 else []
    size = int(bins.start[-1])
    while large:
        def counted(batches):
            place = {key: i for i, key in enumerate(large)}
            held: dict[int, np.ndarray] = {}
            for b, *sums in _chunks(batches, bins):
                for t in sorted({t for t, _ in large}):
                    drew = np.flatnonzero(sums[0][:, t])
                    ends = tops[t].reached(b[drew])
                    for node in np.unique(ends):
                        if (i := place.get((t, int(node)))) is not None:
                            of = drew[ends == node]
                            h = held.setdefault(i, np.zeros((4, size)))
                            for f, start in enumerate(bins.start[:-1]):
                                for j, v in enumerate((None, *(x[of, t] for x in sums))):
                                    h[j, start:start + bins.count[f]] += np.bincount(b[of, f], v, bins.count[f])
            for i, h in held.items():
                yield pa.record_batch({"i": pa.array([i], pa.int32()), "h": pa.array([h.tobytes()], pa.binary())})

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            h = sum(np.frombuffer(v, "f8") for v in pdf["h"])
            return pd.DataFrame({"i": pdf["i"].iloc[:1].astype("int32"), "h": [h.tobytes()]})

        h = np.zeros((4, len(large), size))
        for r in drawn.mapInArrow(counted, "i int, h binary").groupBy("i").applyInPandas(added, "i int, h binary").collect():
            h[:, r["i"]] = np.frombuffer(r["h"], "f8").reshape(4, size)
        of = [slice(s, s + c) for s, c in zip(bins.start, bins.count)]
        total = h[:, :, of[0]].sum(axis=2)
        gain, feature, split, lower = _best_splits(total[1:], lambda f: h[1:, :, of[f]], bins)
        following = []
        for i, (t, at) in enumerate(large):
            top = tops[t]
            top.value[at] = float(_mean(*total[1:3, i]))
            if not gain[i] > 0:
                top.open[at] = False
                continue
            n_lower = h[0, i, of[feature[i]]][:split[i] + 1].sum()
            sides = np.stack([lower[:, i], total[1:, i] - lower[:, i]], axis=1)
            left = top.part(at, int(feature[i]), int(split[i]), _mean(*sides[:2]).tolist())
            for child, n, impure in zip((left, left + 1), (n_lower, total[0, i] - n_lower), np.abs(_variance(*sides)) >= EPSILON):
                if n > LOCAL_ROWS:
                    if impure and top.level[child] < depth:
                        following.append((t, child))
                    else:
                        top.open[child] = False
        large = following
    return tops


class ForestModel:
    """A fitted forest: per tree the arrays (feature, bin, left child, value)."""

    def __init__(self, bins: Bins, trees: list[tuple[np.ndarray, ...]], features: str):
        self.bins, self.trees, self.features = bins, trees, features
        self.uid = "ForestModel"

    @property
    def totalNumNodes(self) -> int:
        return sum(len(t[0]) for t in self.trees)

    @classmethod
    def train(cls, est: RandomForestRegressor, x: DataFrame) -> ForestModel:
        bins, trees, depth = _candidates(est, x), est.getNumTrees(), est.getMaxDepth()
        # rows of equal bins lie next to each other; written once, as every pass must find the same draws
        drawn = materialise(_drawn(est, x, bins).repartition("bins").sortWithinPartitions("bins"))
        tops = _upper(drawn, bins, trees, depth, drawn.select("bins").distinct().count())

        def blocks(batches):
            for b, *sums in _chunks(batches, bins):
                for t in range(trees):
                    drew = np.flatnonzero(sums[0][:, t])
                    ends = tops[t].reached(b[drew])
                    found = [n for n in np.unique(ends).tolist() if tops[t].open[n]]
                    of = [drew[ends == n] for n in found]
                    yield pa.record_batch({
                        "tree": pa.array([t] * len(found), pa.int32()), "node": pa.array(found, pa.int32()),
                        "bins": pa.array([b[i].tobytes() for i in of], pa.binary()),
                        "sums": pa.array([np.stack([v[i, t] for v in sums]).tobytes() for i in of], pa.binary())})

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            t, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
            rows = np.concatenate([np.frombuffer(v, bins.kind) for v in pdf["bins"]]).reshape(-1, len(bins.count))
            sums = np.hstack([np.frombuffer(v, "f8").reshape(3, -1) for v in pdf["sums"]])
            made = _grown(rows, sums, bins, depth - tops[t].level[node])
            return pd.DataFrame([(t, node, *(a.tobytes() for a in made))],
                                columns=["tree", "node", "feature", "split", "left", "value"])

        grown: list[list] = [[] for _ in range(trees)]
        for r in drawn.mapInArrow(blocks, _BLOCK).groupBy("tree", "node").applyInPandas(grow, _TREE).collect():
            grown[r["tree"]].append((r["node"], [np.frombuffer(r[c], k) for c, k in zip(_TREE_ARRAYS, _NODE)]))
        return cls(bins, [_joined(top, parts) for top, parts in zip(tops, grown)], est.getFeaturesCol())

    def transform(self, df: DataFrame) -> DataFrame:
        bins, sent = self.bins, df.sparkSession.sparkContext.broadcast(self.trees)

        @F.pandas_udf("double")
        def predicted(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype="float64")
            rows, total = bins.of(np.stack(features.to_numpy())), np.zeros(len(features))
            for feature, split, left, value in sent.value:
                total = total + value[_walked(rows, feature, split, left)]
            return pd.Series(total / len(sent.value))

        return df.withColumn("prediction", predicted(vector_to_array(F.col(self.features))))


def _joined(top: _Top, parts: list) -> tuple[np.ndarray, ...]:
    """A tree of its upper part and the subtrees of its open nodes."""
    whole = [[np.array(a, k)] for a, k in zip((top.feature, top.split, top.left, top.value), _NODE)]
    size = len(top.feature)
    for node, (feature, split, left, value) in parts:
        left = np.where(feature == LEAF, 0, left + size - 1).astype(left.dtype)  # its root takes the open node's place
        for a, v in zip(whole, (feature, split, left, value)):
            a[0][node] = v[0]
            a.append(v[1:])
        size += len(feature) - 1
    return tuple(np.concatenate(a) for a in whole)
