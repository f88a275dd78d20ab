"""Running chains: a task for each, in blocks that are stored as they end."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.distributions import Dirichlet
from kindred.plans.kernel import Chain, Spec, kept
from kindred.plans.model import Model

#: Rows of a batch of links.
_ROWS = 100_000
_SCHEMA = "chain int, sample int, iter int, kind string, i int, j int, name string, value double, state binary"

#: Columns of each history table, beside chain, sample and iter.
TABLES = {
    "links": [("i", "rid", "bigint"), ("value", "eid", "bigint")],
    "n_linked_ents": [("value", "n", "bigint")],
    "distort_probs": [("i", "fid", "int"), ("j", "aid", "int"), ("value", "p", "double")],
    "distort_counts": [("i", "fid", "int"), ("j", "aid", "int"), ("value", "n", "bigint")],
    "distort_dist_concs": [("j", "aid", "int"), ("value", "b", "double")],
    "clust_params": [("name", "name", "string"), ("value", "value", "double")],
}


def checkpoint_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
            import tempfile

            path = tempfile.mkdtemp(prefix="kindred-chains-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder, read back: plans that use it many times begin there.
    It goes when the driver ends."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def specification(model: Model) -> Spec:
    """The model's encoded tables as arrays, its start included."""
    attributes = list(model.attributes.values())
    spec = arrays(model.record_values, model.domain, model.phi, model.close, attributes, model.prior, model.initial_prior)
    # an entity starts with what its record shows: only what is imputed is gathered
    shown = model.record_values.filter("vid is not null").select(F.col("rid").alias("eid"), "aid")
    start = columns(model.entities.select("eid", "aid", "vid").join(shown.hint("merge"), ["eid", "aid"], "left_anti"))
    spec.start = spec.x.copy()
    spec.start[start["eid"], start["aid"]] = start["vid"]
    return spec


def columns(df: DataFrame) -> dict[str, np.ndarray]:
    """A table without nulls on the driver, as an array for each column."""
    table = df.toArrow()
    out = {c: table[c].to_numpy() for c in table.column_names}
    del table
    pa.default_memory_pool().release_unused()
    return out


def gathered(df: DataFrame) -> pd.DataFrame:
    """A table on the driver, as columns from the start: rows take many times their memory."""
    return df.toArrow().to_pandas()


def arrays(record_values: DataFrame, domain: DataFrame, phi: DataFrame, close: DataFrame, attributes: list, prior, initial_prior) -> Spec:
    """Encoded tables as arrays. They have to fit the task that runs a chain whole, so they
    are gathered once, as columns."""
    # a row for each record: one for each of its values is three times as much on the driver
    k = len(attributes)
    vids = [F.coalesce(F.max(F.when(F.col("aid") == a, F.col("vid"))), F.lit(-1)).cast("int").alias(f"x{a}") for a in range(k)]
    values = columns(record_values.groupBy("rid").agg(F.max("fid").cast("int").alias("fid"), *vids))
    n = int(values["rid"].max()) + 1
    x, file = np.full((n, k), -1, np.int32), np.zeros(n, np.int32)
    for a in range(k):
        x[values["rid"], a] = values.pop(f"x{a}")
    file[values["rid"]] = values["fid"]
    return replace(dictionary_arrays(domain, phi, close, attributes, prior, initial_prior), x=x, file=file, n_files=int(file.max()) + 1)


def dictionary_arrays(domain: DataFrame, phi: DataFrame, close: DataFrame, attributes: list, prior, initial_prior) -> Spec:
    """The same without records."""
    domain = domain.join(phi.select("aid", "vid", "phi"), ["aid", "vid"]).orderBy("aid", "vid")
    close = close.select("aid", "e_vid", "r_vid", "p").orderBy("aid", "e_vid", "r_vid")
    domain, close = gathered(domain), gathered(close)
    emp, factor, start_phi, edges, alpha = [], [], [], [], []
    for a, attribute in enumerate(attributes):
        own, pairs = domain[domain["aid"] == a], close[close["aid"] == a]
        emp.append(own["emp_prob"].to_numpy(float))
        start_phi.append(own["phi"].to_numpy(float))
        factor.append(own["max_exp_factor"].to_numpy(float))
        edges.append(None if attribute.constant else (pairs["e_vid"].to_numpy(int), pairs["r_vid"].to_numpy(int), pairs["p"].to_numpy(float)))
        d = attribute.entity_dist
        if not isinstance(d, Dirichlet):
            alpha.append(None)
        elif isinstance(d.alpha, dict):
            alpha.append(np.array([d.alpha[v] for v in own["value"]]))
        else:
            if isinstance(d.alpha, tuple) and len(d.alpha) != len(own):
                raise ValueError("a Dirichlet prior needs as many parameters as its attribute has values")
            alpha.append(np.array(d.alpha) if isinstance(d.alpha, tuple) else np.full(len(own), float(d.alpha)))
    return Spec(np.empty((0, len(attributes)), np.int64), np.empty(0, np.int64), 0, emp, edges, factor, [t.exclude_entity_value for t in attributes], [t.distort_prob for t in attributes], [t.distort_dist.alpha for t in attributes], start_phi, alpha, prior, initial_prior)


@dataclass
class Fit:
    """History tables (``extract``), the model, and each chain's last state on disk."""

    model: Model
    path: str
    blocks: list[str]
    n_samples: int
    thin: int
    burnin: int
    chains: int
    seed: int
    start: int
    sent: Broadcast | None = None  # the model's arrays, for the call that continues

    @property
    def spark(self) -> SparkSession:
        return self.model.record_values.sparkSession

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(*self.blocks)

    def table(self, name: str) -> DataFrame:
        own = self.rows().filter((F.col("kind") == name) & F.col("state").isNull())
        return own.select("chain", "sample", "iter", *[F.col(c).cast(t).alias(to) for c, to, t in TABLES[name]])

    def extract(self, params: Iterable[str] | None = None, include: bool = True) -> dict[str, DataFrame] | DataFrame:
        """History tables by name; one alone is not wrapped. include=False: all but these."""
        asked = list(TABLES) if params is None else [params] if isinstance(params, str) else list(params)
        unknown = set(asked) - set(TABLES)
        if unknown:
            raise ValueError(f"no such history: {sorted(unknown)}")
        names = asked if include else [t for t in TABLES if t not in asked]
        return self.table(names[0]) if len(names) == 1 else {t: self.table(t) for t in names}

    def samples(self) -> DataFrame:
        """sample, rid, eid over all chains, for the posterior summaries."""
        return self.table("links").select((F.col("chain") * F.lit(1 << 24) + F.col("sample")).alias("sample"), "rid", "eid")

    def labelled(self, rows: DataFrame, *columns: str) -> DataFrame:
        """``rows`` with the records' own ids in place of rid in the ``columns``."""
        ids = self.model.records.select("rid", "rec_id")
        for c in columns or ("rid",):
            names = rows.columns
            rows = rows.join(ids.withColumnRenamed("rid", c), c).drop(c).withColumnRenamed("rec_id", c).select(*names)
        return rows

    def summary(self) -> DataFrame:
        """Number of samples and effective sample size of each scalar of the history."""
        from kindred.operators.clusters import effective_sample_size

        rows = self.rows().filter("state is null and kind <> 'links'")
        name = F.concat_ws(":", "kind", F.col("chain").cast("string"), F.col("i").cast("string"), F.col("j").cast("string"), "name")
        return effective_sample_size(rows.select(name.alias("name"), F.col("sample").cast("bigint").alias("i"), "value"))

    def joint_summary(self) -> DataFrame:
        """name, n, dims, ess of each history table of a chain as one vector; see
        ``multivariate_effective_sample_size``."""
        from kindred.operators.clusters import multivariate_effective_sample_size

        rows = self.rows().filter("state is null and kind not in ('links', 'distort_dist_concs')")
        name, dim = F.concat_ws(":", "kind", F.col("chain").cast("string")), F.concat_ws(":", F.col("i").cast("string"), F.col("j").cast("string"), "name")
        return multivariate_effective_sample_size(rows.select(name.alias("name"), dim.alias("dim"), F.col("sample").cast("bigint").alias("i"), "value"))

    def show(self) -> str:
        """What was run and kept, with the effective sample sizes."""
        lines = [repr(self), f"Recorded: {', '.join(TABLES)}", "Effective sample size:"]
        sizes = self.joint_summary().orderBy("name").collect()
        return "\n".join([*lines, *[f"  {r['name']}: {'unknown' if r['ess'] is None else round(r['ess'], 1)}" for r in sizes]])

    def __repr__(self) -> str:
        return f"Fit({self.n_samples} samples of {self.chains} chains, thin {self.thin}, burn-in {self.burnin})"


def run_inference(model: Model | Fit, n_samples: int, thin: int = 1, burnin: int = 0, chains: int = 1, seed: int = 1, block: int = 1000, progress: Callable[[int, int], bool | None] | None = None) -> Fit:
    """Samples of each chain. A fit is continued: its own thin counts, and no new burn-in. Each
    block of iterations ends in a table with the samples and the chain's state, from
    which the next block, or a later call, goes on; a lost task repeats its block only.

    ``progress`` is called after each block with the iterations done and wanted. If it returns False,
    or an interrupt comes (KeyboardInterrupt), the run ends with the blocks that are whole: the fit then has the
    samples that were saved, none made up, and can be continued. An interrupt before the first
    block ends is raised."""
    earlier = model if isinstance(model, Fit) else None
    if earlier is not None:
        model, thin, chains, seed = earlier.model, earlier.thin, earlier.chains, earlier.seed
        # what an early end left of the burn-in, and of the thinning
        burnin = max(0, earlier.burnin - earlier.start)
    saved = kept(n_samples, thin, burnin)
    start = earlier.start if earlier else 0
    since = (start - earlier.burnin) % thin if earlier and not burnin else 0
    already = earlier.n_samples if earlier else 0
    spark = model.record_values.sparkSession
    sent = earlier.sent if earlier and earlier.sent else spark.sparkContext.broadcast(specification(model))
    path = earlier.path if earlier else f"{checkpoint_folder(spark)}/fit-{uuid.uuid4().hex}"
    wanted = {start - since + it: already + k for k, it in enumerate(saved)}
    last, blocks = max(wanted), list(earlier.blocks) if earlier else []
    at = start
    while at < last:
        upto = min(last, at + block)
        # a task a chain: these numbers of partitions are kept, while those of a grouping would be merged, being small
        if blocks:
            states = spark.read.parquet(blocks[-1]).filter("state is not null").select("chain", "state").repartitionByRange(chains, "chain")
        else:
            states = spark.range(0, chains, 1, chains).select(F.col("id").cast("int").alias("chain"), F.lit(None).cast("binary").alias("state"))
        ours = {it: k for it, k in wanted.items() if at < it <= upto}

        target = f"{path}/{at:09d}-{upto:09d}-{uuid.uuid4().hex[:8]}"
        try:
            states.mapInArrow(_block(sent, seed, at, upto, ours), _SCHEMA).write.parquet(target)
        except KeyboardInterrupt:
            if not blocks:
                raise
            break
        blocks.append(target)
        at = upto
        if progress is not None and progress(at - start, last - start) is False:
            break
    total = already + sum(it <= at for it in wanted)
    if earlier is not None:
        return replace(earlier, blocks=blocks, n_samples=total, start=at)  # burn-in as asked first
    return Fit(model, path, blocks, total, thin, burnin, chains, seed, at, sent)


def _block(sent, seed: int, at: int, upto: int, ours: dict[int, int]):
    def table(number: int, sample: int, it: int, kind: str, i, j, name, value, state=None) -> pa.RecordBatch:
        n = len(value)
        same = lambda v, kind: pa.repeat(pa.scalar(v, kind), n)
        cells = [same(number, pa.int32()), same(sample, pa.int32()), same(it, pa.int32()), same(kind, pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(name, pa.string()), pa.array(value, pa.float64()), same(state, pa.binary())]
        return pa.RecordBatch.from_arrays(cells, [c.split()[0] for c in _SCHEMA.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in (row for batch in batches for row in batch.to_pylist()):
            number, state = given["chain"], given["state"]
            chain = pickle.loads(state).resume(sent.value) if state is not None else Chain(sent.value, seed, number)
            for it in range(at + 1, upto + 1):
                chain.sweep()
                if it not in ours:
                    continue
                for k in range(0, len(chain.link), _ROWS):
                    links = chain.link[k : k + _ROWS]
                    none = [None] * len(links)
                    yield table(number, ours[it], it, "links", np.arange(k, k + len(links)), none, none, links.astype(float))
                for kind, i, j, name, value in chain.history(links=False):
                    yield table(number, ours[it], it, kind, [i], [j], [name], [value])
            yield table(number, -1, upto, "state", [None], [None], [None], [0.0], pickle.dumps(chain))

    return run
