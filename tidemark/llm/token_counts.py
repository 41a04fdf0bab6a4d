"""Token counts kept by signed deltas: additive totals by source, language and tokenizer version.

A batch holds signed rows (an insert +, a delete -, a revision both) already summed by key. A store is a folder of data folders with
arbitrary names, and a log of numbered generations. A commit writes its data, then publishes the next generation in one atomic step
that fails if another writer took that number; it then looks again, and gives up if its batch id is there meanwhile. What no
generation names does not exist, so a writer that dies at any point changes nothing, and a batch id is applied once however often it
is sent and by however many writers. A compaction is a generation too: it names one folder with the sum of all batches up to some
generation, and the ids of these. Readers start from the last compaction, so totals are the same before, during and after one. Old
folders stay until ``vacuum``.

Atomic publishing is a hard link on a local or mounted file system and a rename elsewhere, which HDFS refuses if the target exists;
an object store without such a rename needs one writer.

Each task counts its rows and hands on partial sums (map-side aggregation), so a hot source crosses the
shuffle as one row a task. Defined results: null texts count no tokens and one document; null source or
language is a key of its own; texts are counted whole; repeated rows count each; an empty table gives an empty total;
other columns are ignored. Batch ids are any texts.
"""

from __future__ import annotations

import base64
import json
import time
import uuid

import public_tokenizers
import pyarrow as pa
import tiktoken
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import batches, held, text_of

KEYS = ("source", "lang", "tokenizer_version")
MEASURES = ("n_docs", "n_tokens", "n_chars")
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_chars long"


def _encoding(name: str) -> tiktoken.Encoding:
    return held(("tiktoken", name), lambda: _loaded(name))


def _loaded(name: str) -> tiktoken.Encoding:
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(docs: DataFrame, version: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens, n_chars of each row."""

    def run(frames):
        encoding = _encoding(version)
        for batch in batches(frames):
            texts = batch.column(3).to_pylist()
            n = [len(encoding.encode_ordinary(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64()), pa.array(map(len, texts), pa.int64())], ["doc_id", "source", "lang", "tokenizer_version", "n_tokens", "n_chars"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), docs[lang_col].cast("string").alias("lang"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, source string, lang string, tokenizer_version string, n_tokens long, n_chars long")


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Counted rows as additive deltas: +1 for inserts, -1 for deletes."""
    return rows.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"), (F.col("n_chars") * sign).alias("n_chars"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Deltas that replace earlier counted rows by later ones."""
    return signed(before, -1).unionByName(signed(after, 1))


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(*(F.sum(m).cast("long").alias(m) for m in MEASURES))


class RollupStore:
    """Committed batches under one folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("log").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path("log", name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _state(self) -> tuple[int, list[dict]]:
        """The last generation's number, and the entries that make up the totals: a compaction, if any, and the commits it lacks."""
        names = [n for n in self._names("log") if n.endswith(".json")]
        entries, covered = [], -1
        for name in reversed(names):
            number = int(name.split(".")[0])
            if number <= covered:
                break
            entry = self._read(name)
            if "covers" in entry:
                if covered < 0:  # the newest compaction; the folders of older ones are in its sum
                    entries.append(entry)
                    covered = entry["covers"]
            else:
                entries.append(entry)
        return (int(names[-1].split(".")[0]) if names else 0), entries

    def _publish(self, number: int, entry: dict) -> bool:
        """Make a generation visible, whole and at once. False if the number is taken."""
        target, draft = self._path("log", f"{number:020d}.json"), self._path("drafts", uuid.uuid4().hex)
        stream = self._fs.create(draft, True)
        try:
            stream.write(json.dumps(entry).encode())
        finally:
            stream.close()
        self._fs.mkdirs(self._path("log"))
        if self._fs.getUri().getScheme() == "file":
            local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                self._jvm.java.nio.file.Files.createLink(local(target), local(draft))
                done = True
            except Py4JJavaError as error:
                if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                    raise
                done = False
            self._fs.delete(draft, False)
        else:
            done = not self._fs.exists(target) and self._fs.rename(draft, target)
            if not done:
                self._fs.delete(draft, False)
        return done

    def _write(self, deltas: DataFrame) -> str:
        folder = uuid.uuid4().hex
        summed(deltas).write.parquet(f"{self.path}/data/{folder}")
        return folder

    def committed(self) -> list[str]:
        """Batch ids that are part of the totals."""
        return sorted(x for entry in self._state()[1] for x in entry["batches"])

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Apply a batch once. False: it was committed before."""
        if batch_id in self.committed():
            return False
        folder = self._write(deltas)
        while True:
            last, entries = self._state()
            if any(batch_id in entry["batches"] for entry in entries):  # another writer was faster
                self._fs.delete(self._path("data", folder), True)
                return False
            if self._publish(last + 1, {"folder": folder, "batches": [batch_id]}):
                return True

    def totals(self) -> DataFrame:
        """Current totals; keys whose documents are all gone have no row."""
        return self._sum(self._state()[1])

    def _sum(self, entries: list[dict]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/data/{entry['folder']}" for entry in entries))
        return summed(rows).where("n_docs != 0 OR n_tokens != 0 OR n_chars != 0")

    def compact(self) -> None:
        """One folder for all batches so far; batches committed meanwhile stay beside it."""
        covers, entries = self._state()
        if len(entries) < 2:
            return
        entry = {"covers": covers, "folder": self._write(self._sum(entries)), "batches": sorted(x for e in entries for x in e["batches"])}
        while not self._publish(self._state()[0] + 1, entry):
            pass

    def vacuum(self, older_than: float = 86_400.0) -> None:
        """Delete data that no totals need, if it is older than any reader or writer may run (seconds)."""
        keep = {entry["folder"] for entry in self._state()[1]}
        for status in self._fs.listStatus(self._path("data")) if self._fs.exists(self._path("data")) else []:
            if status.getPath().getName() not in keep and status.getModificationTime() / 1000 < time.time() - older_than:
                self._fs.delete(status.getPath(), True)
