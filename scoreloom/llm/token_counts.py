"""Token counts as rollups that signed changes maintain.

Totals of documents and tokens by source, language and tokenizer version are kept as a set of
committed delta tables. A batch of changes (inserts, deletes and revised counts) is summed to one
signed row a group and written under a name of its own, with a record of it; then the batch's seal,
which names the data, is written beside and renamed to its place, which fails if the batch has one
already. Only sealed data count. So a batch counts once, however often it is sent and whoever else
sends it, and what a failed attempt has written is never summed. This needs a file system whose rename
is atomic and does not overwrite, as HDFS has; on an object store use one writer. ``compact`` sums the
live deltas to one table and removes their records, so that readers look at one manifest and at the
records since then; what the manifest before has replaced is deleted, so readers may lag by one
compaction. Seals stay for good, but only their own batch looks them up.

Counting runs the real tokenizers over whole texts in one narrow pass, in time about linear in a text.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .cut import cut, remove, shared_folder

GROUP = ("source", "lang", "tokenizer")
#: Fixed value: the pattern by which these byte-level vocabularies split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Whitespace as the pattern has it, in runs that are too long for its engine.
_LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{20000,}+")


@dataclass
class Tokenizer:
    """A tokenizer version; its ranks travel to the workers with the function, so they need no file."""

    version: str
    ranks: dict[bytes, int] = field(repr=False)
    pattern: str = SPLIT

    @classmethod
    def from_file(cls, version: str, path: str, pattern: str = SPLIT) -> Tokenizer:
        """From lines of base64 token and rank, a vocabulary of bounded size that the driver reads."""
        with open(path, "rb") as lines:
            return cls(version, {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def encoding(self):
        import tiktoken

        if self.version not in _BUILT:
            _BUILT[self.version] = tiktoken.Encoding(self.version, pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return _BUILT[self.version]

    def tokens(self, text: str) -> int:
        """Number of tokens of a text. Under SPLIT, very long runs of whitespace are taken out where the pattern parts them: all but the last character, which the next token may begin with."""
        encode, total, here = self.encoding().encode_ordinary, 0, 0
        if self.pattern == SPLIT and len(text) >= 20000:
            for m in _LONG_SPACE.finditer(text):
                end = m.end() if m.end() == len(text) else m.end() - 1
                total += len(encode(text[here : m.start()])) + len(self.encoding()._core_bpe.encode_single_piece(text[m.start() : end].encode()))
                here = end
        return total + len(encode(text[here:] if here else text))


_BUILT: dict = {}


def count(docs: DataFrame, tokenizers: list[Tokenizer], doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens and estimate (bytes / 4, rounded up) of every row for every tokenizer. A null text has no tokens."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)
    names = [t.version for t in tokenizers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, offsets in K.slices(batch, 3, 4 * K.BLOCK):
                texts = part.column(3).to_pylist()
                own = [[k.tokens(t) if t else 0 for t in texts] for k in shared.value]
                flat = pa.array(np.array(own, np.int64).T.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(names), dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(-(-np.diff(offsets) // 4)), lists], names=["doc_id", "source", "lang", "estimate", "counts"])

    out = base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, source string, lang string, estimate bigint, counts array<bigint>")
    return out.select("doc_id", "source", "lang", "estimate", F.posexplode("counts").alias("n", "tokens")).select("doc_id", "source", "lang", F.element_at(F.array(*map(F.lit, names)), F.col("n") + 1).alias("tokenizer"), "tokens", "estimate")



def inserts(counts: DataFrame, tokens: str = "tokens") -> DataFrame:
    return counts.select(*GROUP, F.lit(1).cast("long").alias("docs"), F.col(tokens).alias("tokens"))


def deletes(counts: DataFrame, tokens: str = "tokens") -> DataFrame:
    return counts.select(*GROUP, F.lit(-1).cast("long").alias("docs"), (-F.col(tokens)).alias("tokens"))


def revisions(counts: DataFrame, old: str, new: str = "tokens") -> DataFrame:
    return counts.select(*GROUP, F.lit(0).cast("long").alias("docs"), (F.col(new) - F.col(old)).alias("tokens"))


class Rollup:
    """Totals in a folder that driver and executors share. A null count is 0; null sources and languages are groups of their own."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _write(self, changes: DataFrame) -> str:
        """Changes summed and written under a new name; nothing reads it before it is recorded."""
        name = uuid.uuid4().hex
        zero = F.lit(0).cast("long")
        sums = changes.groupBy(*GROUP).agg(F.coalesce(F.sum("docs"), zero).alias("docs"), F.coalesce(F.sum("tokens"), zero).alias("tokens"))
        sums.where("docs <> 0 OR tokens <> 0").write.parquet(f"{self.folder}/data/{name}")
        return name

    def _create(self, place: str, what: dict) -> bool:
        """A file with a line of JSON, there whole or not at all; False if there is one."""
        jvm = self.spark._jvm
        draft = self._path(f"{self.folder}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray((json.dumps(what) + "\n").encode()))
        out.close()
        target = self._path(f"{self.folder}/{place}")
        self._fs.mkdirs(target.getParent())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.isAbsolute() and target.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(draft, target, options)
        except Exception:
            self._fs.delete(draft, False)
            if self._fs.exists(target):
                return False
            raise
        return True

    def _lines(self, place: str) -> list[dict] | None:
        """The records in a folder, which ``compact`` keeps short; None if some went away meanwhile."""
        where = self._path(f"{self.folder}/{place}")
        if not self._fs.exists(where) or not len(self._fs.listStatus(where)):
            return []
        try:
            return [json.loads(r.value) for r in self.spark.read.text(f"{self.folder}/{place}").collect()]
        except Exception as error:
            if "FILE_NOT_EXIST" in str(error) or "FileNotFound" in str(error):
                return None
            raise

    def _seal(self, batch: str) -> str:
        return f"seals/{batch.encode().hex()}"

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{self._seal(batch)}"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of signed changes (GROUP, docs, tokens); False, and no effect, if it was applied before."""
        if self.committed(batch):
            return False
        data = self._write(changes)
        self._create(f"live/{data}", {"batch": batch, "data": data})
        if self._create(self._seal(batch), {"data": data}):
            return True
        self._fs.delete(self._path(f"{self.folder}/live/{data}"), False)
        return False

    def _sealed(self, record: dict) -> bool:
        place = self._path(f"{self.folder}/{self._seal(record['batch'])}")
        if not self._fs.exists(place):
            return False
        stream = self._fs.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["data"] == record["data"]
        finally:
            stream.close()

    def _live(self) -> tuple[dict, list[dict]]:
        """The last manifest, and the records of sealed batches that it does not cover."""
        latest = lambda: max(self._lines("manifests") or [], key=lambda m: m["version"], default={"version": 0, "data": None, "covers": [], "replaced": []})
        manifest = latest()
        while True:
            records = self._lines("live")
            after = latest()
            # records go only after the manifest that covers them is there
            if records is not None and after["version"] == manifest["version"]:
                covered = set(manifest["covers"])
                return manifest, [r for r in records if r["data"] not in covered and self._sealed(r)]
            manifest = after

    def totals(self) -> DataFrame:
        """GROUP, n_docs and n_tokens of the groups that have any."""
        manifest, records = self._live()
        return self._sums(manifest, records)

    def _sums(self, manifest: dict, records: list[dict]) -> DataFrame:
        live = [d for d in (manifest["data"], *(r["data"] for r in records)) if d]
        if not live:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        rows = self.spark.read.schema("source string, lang string, tokenizer string, docs long, tokens long").parquet(*(f"{self.folder}/data/{d}" for d in live))
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> bool:
        """Sum up what is committed in one table. Batches that are committed meanwhile stay beside it; of two compactions at once one has no effect."""
        manifest, records = self._live()
        self._tidy(manifest)
        if not records:
            return False
        name = self._write(self._sums(manifest, records).select(*GROUP, F.col("n_docs").alias("docs"), F.col("n_tokens").alias("tokens")))
        new = {"version": manifest["version"] + 1, "data": name, "covers": [r["data"] for r in records], "replaced": [d for d in (manifest["data"], *(r["data"] for r in records)) if d]}
        if not self._create(f"manifests/{new['version']:012d}", new):
            return False
        for data in manifest["replaced"]:
            self._fs.delete(self._path(f"{self.folder}/data/{data}"), True)
        self._tidy(new)
        return True

    def _tidy(self, manifest: dict) -> None:
        """Remove the records that a manifest covers, also those that a failed compaction has left, and the manifests before the last two."""
        for data in manifest["covers"]:
            self._fs.delete(self._path(f"{self.folder}/live/{data}"), False)
        self._fs.delete(self._path(f"{self.folder}/manifests/{manifest['version'] - 2:012d}"), False)


def maintained(docs: DataFrame, withdrawn: DataFrame, tokenizers: list[Tokenizer], folder: str) -> DataFrame:
    """Totals after four batches: all documents by estimate, exact counts for estimates, withdrawn documents (doc_id) off, and the second and third sent once more. The folder goes in the end."""
    counts = cut(count(docs, tokenizers))
    gone = counts.join(withdrawn.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
    rollup = Rollup(docs.sparkSession, folder)
    for batch, changes in [("load", inserts(counts, "estimate")), ("exact", revisions(counts, "estimate")), ("withdraw", deletes(gone)), ("exact", revisions(counts, "estimate")), ("withdraw", deletes(gone))]:
        rollup.commit(batch, changes)
    rollup.compact()
    totals = cut(rollup.totals())
    remove(docs.sparkSession, folder)
    return totals


def query(spark: SparkSession, sf_dir: str, vocabularies: str = "/opt/tokenizers") -> DataFrame:
    """Totals of all documents but those labelled toxic, in two tokenizer versions."""
    tokenizers = [Tokenizer.from_file(name, f"{vocabularies}/{name}.tiktoken") for name in ("byte_bpe_50k", "byte_bpe_multi_50k")]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return maintained(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.where("toxic = 1"), tokenizers, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
