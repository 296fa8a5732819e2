"""S1 sources: the driver's parquet tables and one-file-per-document corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unveil.session import work_path
from unveil.sources import store

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, pages and conversation turns as one evidence table.

    ``evidence_id`` is ``<origin>-<key>``; ``text`` is the raw text (html for
    pages). Each branch prunes to the columns it needs before the union.
    """
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("evidence_id"),
        F.lit("documents").alias("origin"),
        F.col("text"),
    )
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("evidence_id"),
        F.lit("pages").alias("origin"),
        F.col("html").alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(
            F.lit("conv-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")
        ).alias("evidence_id"),
        F.lit("conversations").alias("origin"),
        F.col("text"),
    )
    return docs.unionByName(pages).unionByName(turns)


def text_corpus(spark: SparkSession, root: str, pattern: str = "*/*.txt") -> DataFrame:
    """One UTF-8 document per file; label = parent folder, id = label/file stem.

    ``wholetext`` keeps a file in one row: hiding tricks span lines.
    """
    df = spark.read.text(f"{root.rstrip('/')}/{pattern}", wholetext=True)
    path = F.col("_metadata.file_path")
    parts = F.split(path, "/")
    label = F.element_at(parts, -2)
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.txt$", "")
    return df.select(
        F.concat(label, F.lit("/"), stem).alias("evidence_id"),
        label.alias("label"),
        F.col("value").alias("text"),
    )


def one_file_each(rows: DataFrame, root: str) -> None:
    """Writes ``rows`` (doc, body binary) as ``<root>/doc=<doc>/part-<task>.txt``, the folders that ``partitionBy("doc")`` makes.

    Each task opens its files itself through Arrow's file systems (local paths, and the stores that
    Arrow knows by URI): a partitioned Spark write has a permission process for each file of a
    local store and moves each folder on the driver. Rows of a task with one doc share a file. A
    task that runs again writes the same names.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store_, base = fs.FileSystem.from_uri(root.removeprefix("file:") if root.startswith("file:/") else root)
        part, now, out, n = f"part-{TaskContext.get().partitionId():05d}.txt", None, None, 0
        for batch in batches:
            for doc, body in zip(batch.column(0), batch.column(1)):
                doc = doc.as_py()
                if out is None or doc != now:
                    if out is not None:
                        out.close()
                    folder = f"{base}/doc={'__HIVE_DEFAULT_PARTITION__' if doc is None else doc}"
                    store_.create_dir(folder, recursive=True)
                    now, out, n = doc, store_.open_output_stream(f"{folder}/{part}"), n + 1
                out.write(body.as_buffer())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows.select("doc", "body").sortWithinPartitions("doc").mapInArrow(run, "n long").agg({"n": "sum"}).collect()


SMALL_PARTS, TASK_BYTES, TASK_FILES, READ_BYTES = 64, 32 << 20, 1 << 14, 4 << 20


def file_list(spark: SparkSession, root: str, pattern: str = "*/*.txt") -> DataFrame | None:
    """(folder, name, modificationTime, length) of the files two levels below ``root`` that Spark's file sources would read.

    Made and kept by tasks, so the driver holds no file: Spark's own index has each one there, with
    its folder. One task lists the folders, all tasks the files in them; the table is in the shared
    folder. None where only Spark's readers can tell the files: other patterns, and stores that
    Arrow does not know by URI.
    """
    if pattern != "*/*.txt" or any(c in root for c in "*?[{\\") or not store.exists(spark, root):
        return None
    base = _arrow_path(store.qualified(spark, root))
    if base is None:
        return None
    local = base.startswith("/")
    missing = spark.conf.get("spark.sql.files.ignoreMissingFiles").lower() == "true"

    def folders(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs

        def names():
            if local:
                with os.scandir(base) as entries:
                    yield from (e.name for e in entries if e.is_dir())
            else:
                store_, top = fs.FileSystem.from_uri(base)
                yield from (i.base_name for i in store_.get_file_info(fs.FileSelector(top)) if i.type == fs.FileType.Directory)

        for batch in batches:
            part = []
            for name in names() if batch.num_rows else ():
                part.append(name)
                if len(part) == 10000:
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["folder"])
                    part = []
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["folder"])

    def files(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs

        store_, top = (None, base) if local else fs.FileSystem.from_uri(base)

        def within(folder):
            if local:
                with os.scandir(f"{base}/{folder}") as entries:
                    for e in entries:
                        if wanted(e.name) and e.is_file():
                            yield e.name, e.stat().st_mtime_ns, e.stat().st_size
            else:
                for i in store_.get_file_info(fs.FileSelector(f"{top}/{folder}")):
                    if wanted(i.base_name) and i.type == fs.FileType.File:
                        yield i.base_name, i.mtime_ns or 0, i.size

        def wanted(name):
            # Spark passes over names that it takes for hidden
            return name.endswith(".txt") and not name.startswith(".") and ("=" in name or not name.startswith("_"))

        names, types = ["folder", "name", "modificationTime", "length"], [pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int64()]
        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for batch in batches:
            part = []
            for folder in batch.column(0).to_pylist():
                try:
                    for name, at, size in within(folder):
                        # Spark's file sources pass over files of no bytes
                        if size:
                            part.append((folder, name, at // 10**6 * 1000, size))
                        if len(part) == 10000:
                            yield table(part)
                            part = []
                except FileNotFoundError:
                    if not missing:
                        raise
            yield table(part)

    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    listed = spark.range(0, 1, 1, 1).mapInArrow(folders, "folder string").repartition(parts, "folder")
    listed = listed.mapInArrow(files, "folder string, name string, modificationTime timestamp, length long")
    path = work_path(spark, "file-list")
    listed.write.parquet(path)
    return spark.read.schema(listed.schema).parquet(path)


def _arrow_path(root: str) -> str | None:
    """What Arrow's file systems take for a path that Spark has qualified; None if they have none for it."""
    from urllib.parse import quote

    import pyarrow as pa
    from pyarrow import fs

    if root.startswith("file:/"):
        return root.removeprefix("file:").rstrip("/") or "/"
    try:
        if quote(root, safe="/:@=,+~") == root:
            fs.FileSystem.from_uri(root)
            return root.rstrip("/")
    except (pa.ArrowException, OSError, ImportError):
        pass
    return None


def contents(spark: SparkSession, listed: DataFrame, root: str) -> DataFrame:
    """The ``binaryFile`` table of files that ``file_list`` found: each is read by one task, in parts of about READ_BYTES.

    A task gets TASK_BYTES or TASK_FILES on average. As in Spark's readers, a local file with
    Hadoop's checksums beside it is held to them, and the settings that pass over files that are
    gone or cannot be read apply.
    """
    top = store.qualified(spark, root).rstrip("/")
    base, most = _arrow_path(top), READ_BYTES
    local = base.startswith("/")
    missing, corrupt = (spark.conf.get(f"spark.sql.files.ignore{kind}Files").lower() == "true" for kind in ("Missing", "Corrupt"))

    def read(batches):
        import zlib
        from array import array
        from itertools import accumulate

        import pyarrow as pa
        from pyarrow import fs

        store_, at = (None, base) if local else fs.FileSystem.from_uri(base)

        def content(path):
            if not local:
                with store_.open_input_stream(f"{at}{path.removeprefix(top)}", compression=None) as f:
                    return f.read()
            path = f"{base}{path.removeprefix(top)}"
            with open(path, "rb") as f:
                data = f.read()
            folder, _, name = path.rpartition("/")
            try:
                with open(f"{folder}/.{name}.crc", "rb") as f:
                    sums = f.read()
            except OSError:
                return data
            step, view = int.from_bytes(sums[4:8], "big"), memoryview(data)
            if sums[:4] == b"crc\0" and step:
                for k, i in enumerate(range(0, len(data), step)):
                    if sums[8 + 4 * k:12 + 4 * k] != zlib.crc32(view[i:i + step]).to_bytes(4, "big"):
                        raise OSError(f"Checksum error: {path} at {i}")
            return data

        def table(batch, rows, texts):
            bounds = array("i", accumulate(map(len, texts), initial=0))
            body = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds), pa.py_buffer(b"".join(texts))])
            path, changed = (c.take(pa.array(rows, pa.int64())) for c in batch.columns)
            return pa.RecordBatch.from_arrays(
                [path, changed, pa.array([len(t) for t in texts], pa.int64()), body], ["path", "modificationTime", "length", "content"])

        for batch in batches:
            rows, texts, held = [], [], 0
            for k, path in enumerate(batch.column(0).to_pylist()):
                try:
                    data = content(path)
                except FileNotFoundError:
                    if missing:
                        continue
                    raise
                except OSError:
                    if corrupt:
                        continue
                    raise
                if texts and held + len(data) > most:
                    yield table(batch, rows, texts)
                    rows, texts, held = [], [], 0
                rows.append(k)
                texts.append(data)
                held += len(data)
            yield table(batch, rows, texts)

    n, size = listed.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = max(1, min(n, max(2 * spark.sparkContext.defaultParallelism, size // TASK_BYTES, n // TASK_FILES)))
    path = F.concat(F.lit(f"{top}/"), "folder", F.lit("/"), "name").alias("path")
    return listed.select(path, "modificationTime").repartition(parts, "path").mapInArrow(
        read, "path string, modificationTime timestamp, length long, content binary")


def binary_files(spark: SparkSession, root: str, pattern: str = "*/*.txt") -> DataFrame:
    """The ``binaryFile`` table of a corpus of folders, its files listed and read by tasks where ``file_list`` can."""
    listed = file_list(spark, root, pattern)
    return _indexed_files(spark, root, pattern) if listed is None else contents(spark, listed, root)


def _indexed_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """The same from Spark's own index of the files, which the driver holds.

    With the usual pattern folders are listed by tasks; a pattern of paths would list each on the
    driver. Spark counts every small file as 4 MB, so up to SMALL_PARTS of its splits go to one
    task, as long as it reads no more than TASK_BYTES on average.
    """
    reader, root = spark.read.format("binaryFile"), root.rstrip("/")
    if pattern != "*/*.txt" or any(c in root for c in "*?[{"):
        return reader.load(f"{root}/{pattern}")
    here = F.size(F.split("path", "/")) == store.qualified(spark, root).count("/") + 3
    label = F.element_at(F.split("path", "/"), -2)
    files = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root)
    splits, size = files.rdd.getNumPartitions(), int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = files.coalesce(max(1, 2 * spark.sparkContext.defaultParallelism, size // TASK_BYTES, splits // SMALL_PARTS)).where(here)
    # a walk through folders passes over names that Spark takes for hidden, a pattern does not
    unseen = "{[_.]*,*._COPYING_}/*.txt"
    if store.matches(spark, f"{root}/{unseen}"):
        hidden = label.startswith(".") | (label.startswith("_") & ~label.contains("=")) | label.endswith("._COPYING_")
        files = files.unionByName(spark.read.format("binaryFile").load(f"{root}/{unseen}").where(hidden))
    return files


LONGEST_FILE = 1 << 30


def strict_text_corpus(spark: SparkSession, root: str, pattern: str = "*/*.txt", longest: int = LONGEST_FILE) -> tuple[DataFrame, DataFrame]:
    """One document per file, decoded strictly: (corpus, quarantine).

    The corpus has the columns and rows of ``text_corpus`` but for files that
    are no UTF-8 (bytes cut off, overlong forms, surrogates and values past
    U+10FFFF included) or longer than ``longest`` bytes. These are
    listed in the quarantine: evidence_id, label, path, n_bytes, reason
    (``not_utf8`` or ``too_long``). No byte is replaced, and a
    file is read by one task; one that is too long is not opened at all.
    Spark's file sources pass over files of no bytes, so neither reader has a
    row for them.
    """
    listed = file_list(spark, root, pattern)
    if listed is None:
        # the bound on the length reaches the scan, which fails on files beyond its own limit
        files = _indexed_files(spark, root, pattern)
        within = files.where(F.col("length") <= longest)
    else:
        files = listed.select(F.concat(F.lit(store.qualified(spark, root).rstrip("/") + "/"), "folder", F.lit("/"), "name").alias("path"), "length")
        within = contents(spark, listed.where(F.col("length") <= longest), root)
    parts = F.split("path", "/")
    label = F.element_at(parts, -2)
    named = [
        F.concat(label, F.lit("/"), F.regexp_replace(F.element_at(parts, -1), r"\.txt$", "")).alias("evidence_id"),
        label.alias("label"),
    ]
    text = F.col("content").cast("string")
    read = within.select(*named, "path", F.col("length").alias("n_bytes"), text.alias("text"))
    corpus = read.where(F.is_valid_utf8("text")).select("evidence_id", "label", "text")
    broken = read.where(~F.is_valid_utf8("text")).select("evidence_id", "label", "path", "n_bytes", F.lit("not_utf8").alias("reason"))
    too_long = files.where(F.col("length") > longest).select(*named, "path", F.col("length").alias("n_bytes"), F.lit("too_long").alias("reason"))
    return corpus, broken.unionByName(too_long)
