"""Token counts as delta-maintained rollups.

Every change of the corpus is a signed delta: an insert adds a document and its tokens, a delete takes them
away, a revised count does both. Deltas are summed by source, language and tokenizer version and committed in
batches; totals are the sum of the committed batches. A batch is committed once: its rows are written under
a name of their own, and it counts from the moment its commit record, written beforehand, is renamed into place, which succeeds for
one writer only (on file systems whose rename does not replace). A batch that was committed before is not computed again, and what a lost writer left is never read.

Defined cases: a null text has 0 tokens and still counts as a document. Null sources and languages are keys
of their own. Rows that repeat each count. Totals without any document and token are left out; an empty table
commits an empty batch.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how the byte-pair vocabularies split a text before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ["source", "lang", "tokenizer_version"]
SCHEMA = "source string, lang string, tokenizer_version string, docs long, tokens long"
_LOADED: dict[str, object] = {}


def encoding(path: str):
    """The byte-pair tokenizer of a rank file, loaded once per worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:  # a vocabulary installed on every machine, not an input table
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def counted(docs: DataFrame, path: str, version: str) -> DataFrame:
    """doc_id, source, lang, text_hash, tokenizer_version, tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path)
        for batch in batches:
            counts = [len(own.encode_ordinary(x.as_py())) if x.is_valid else 0 for x in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["doc_id", "source", "lang", "text_hash", "tokenizer_version", "tokens"])

    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, lang string, text_hash long, tokenizer_version string, tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), "tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts that replace others; sources, languages and versions may differ too."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals in a shared folder: ``rows/<name>`` holds summed deltas, ``commits/<batch>`` names the one that counts."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        path, files = self._path(f"commits/{batch}")
        return files.exists(path) and files.getFileStatus(path).getLen() > 0  # an empty record is no commit

    def commit(self, batch: str, deltas: Callable[[], DataFrame]) -> bool:
        """Add a batch of signed deltas; False, with nothing done, if it was committed before."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch is named by letters, digits, - and _")
        if self.committed(batch):
            return False
        name = f"rows/{uuid.uuid4().hex}"
        summed = deltas().groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        summed.write.parquet(f"{self.folder}/{name}")
        return self._publish(batch, name)

    def _publish(self, batch: str, name: str) -> bool:
        """Write the commit record under a private name, then rename it, which fails if another writer was first."""
        draft, files = self._path(f"drafts/{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(name.encode()))
        out.close()
        path, _ = self._path(f"commits/{batch}")
        if files.exists(path) and not self.committed(batch):
            files.delete(path, False)  # an empty record, left by a writer that died
        files.mkdirs(path.getParent())
        if not self.committed(batch) and files.rename(draft, path):
            return True
        files.delete(draft, False)
        if self.committed(batch):
            return False
        raise RuntimeError(f"batch {batch} could not be committed")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, docs, tokens: the sum of all committed batches."""
        path, files = self._path("commits")
        if not files.exists(path):
            return self.spark.createDataFrame([], SCHEMA)
        names = [r["value"] for r in self.spark.read.text(f"{self.folder}/commits").collect()]  # one short line per batch; an empty record has none
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/{n}" for n in sorted(names)])
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")


def later_copies(counts: DataFrame) -> DataFrame:
    """Rows whose text a row of smaller doc_id has too (texts by their hash; rows of one doc_id are no copies of each other)."""
    first = counts.groupBy(F.col("text_hash").alias("of")).agg(F.min("doc_id").alias("first"))
    return counts.join(first, F.col("text_hash") == F.col("of")).filter(F.col("doc_id") > F.col("first")).select(*counts.columns)
