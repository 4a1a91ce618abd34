"""CoNLL text: sentence rows to lines, files to sentence rows.

A document opens with '# code', a sentence is token TAB label lines, and a blank
line closes it. A token may itself start with '#': the header is the line
without a TAB.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that one task reads.
RANGE_BYTES = 64 << 20


def document_blocks(sentences: DataFrame, key: str) -> DataFrame:
    """(key, block): the CoNLL text of one document; TAB and line breaks in tokens become spaces."""
    return _blocks(sentences, key, key)


def _blocks(sentences: DataFrame, key: str, name: str) -> DataFrame:
    """Blocks by ``key``; the header shows ``name``, which depends on it."""
    def spaced(token):
        for sign in "\t\r\n":
            token = F.replace(token, F.lit(sign), F.lit(" "))
        return token

    lines = F.zip_with("tokens", "labels", lambda t, l: F.concat(spaced(t), F.lit("\t"), l))
    body = F.concat(F.array_join(lines, "\n"), F.lit("\n"))
    ordered = F.sort_array(F.collect_list(F.struct("sent_idx", body.alias("body"))))
    return sentences.groupBy(key).agg(ordered.alias("_s"), F.first(name).cast("string").alias("_name")).select(
        key,
        F.concat(
            F.lit("# "), "_name", F.lit("\n"),
            F.array_join(F.transform("_s", lambda s: s["body"]), "\n"),
        ).alias("block"),
    )


def write_conll(sentences: DataFrame, key: str, path: str) -> None:
    """One text part per task; a document is never split over parts."""
    document_blocks(sentences, key).select(F.concat("block", F.lit("\n")).alias("value")).write.option(
        "lineSep", "\n"
    ).mode("overwrite").text(path)


def split_blocks(sentences: DataFrame, key: str) -> DataFrame:
    """(split, key, block): the CoNLL text of each document on each side; rows without a ``split`` column are an error."""
    if "split" not in sentences.columns:
        raise ValueError("sentences have no column 'split': split them first")
    side = F.struct("split", key).alias("_side")
    lines = sentences.select(side, F.col(key).alias("_key"), "sent_idx", "tokens", "labels")
    return _blocks(lines, "_side", "_key").select(F.col("_side.split").alias("split"), F.col("_side")[key].alias(key), "block")


def write_split_conll(sentences: DataFrame, key: str, root: str) -> None:
    """The CoNLL files of both sides in one pass, below split=train and split=test."""
    split_blocks(sentences, key).select("split", F.concat("block", F.lit("\n")).alias("value")).write.option(
        "lineSep", "\n").partitionBy("split").mode("overwrite").text(root)


def parse_blocks(blocks: DataFrame, source: str, text: str) -> DataFrame:
    """(source, codigo, sent_idx, tokens, labels) from CoNLL text, one row per sentence.

    Headers, blank lines and TABs cut the text inside its own row, so nothing is shuffled. Only U+000A ends a line, as
    for the reader's ranges. A header has no TAB, so it falls out with the other lines that have none. A block is cut into
    lines once and its lines aren't cut by patterns.
    """
    documents = blocks.select(source, F.posexplode(F.split(text, r"(?md)^# (?=[^\t\n]*$)")).alias("_at", "_doc")).where(
        F.rlike("_doc", F.lit(r"\S"))
    )
    code = F.when(F.col("_at") > 0, F.regexp_replace(F.substring_index("_doc", "\n", 1), r"\r$", ""))
    sentences = F.filter(F.split("_doc", r"\n[ \r]*\n"), lambda b: F.contains(b, F.lit("\t")))
    # the code comes first, so that no sentence carries its document's text
    rows = documents.select(source, code.alias("codigo"), "_doc").select(source, "codigo", F.posexplode(sentences).alias("sent_idx", "_block"))
    lines = F.split(F.replace("_block", F.lit("\r\n"), F.lit("\n")), "\n")
    rows = rows.select(source, "codigo", "sent_idx", F.filter(lines, lambda line: F.contains(line, F.lit("\t"))).alias("_lines"))
    return rows.select(
        source, "codigo", "sent_idx",
        F.transform("_lines", lambda line: F.substring_index(line, "\t", 1)).alias("tokens"),
        F.transform("_lines", lambda line: F.substring_index(F.substring_index(line, "\t", 2), "\t", -1)).alias("labels"),
    )


class ConllSource(DataSource):
    """Documents of CoNLL files as (path, text), read by byte ranges: ``spark.read.format("conll")``.

    A range owns the documents whose header line begins in it and reads the last of them to its end; the start of a
    file owns what stands before the first header. One document is held at a time. The path is a file or a
    folder on any file system Arrow opens by its URI; option ``bytes`` is the size of a range.
    """

    @classmethod
    def name(cls):
        return "conll"

    def schema(self):
        return "path string, text string"

    def reader(self, schema):
        return ConllReader(self.options["path"], int(self.options.get("bytes", RANGE_BYTES)))


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class ConllReader(DataSourceReader):
    def __init__(self, root: str, size: int):
        self.root, self.size = root if "://" in root else os.path.abspath(root), size

    def partitions(self):
        files, path = fs.FileSystem.from_uri(self.root)
        info = files.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(path))
        shown = [f for f in found if f.is_file and not f.base_name.startswith(("_", "."))]
        return [ByteRange(f.path, at, min(at + self.size, f.size)) for f in shown for at in range(0, f.size, self.size)]

    def read(self, partition):
        files, _ = fs.FileSystem.from_uri(self.root)
        with files.open_input_file(partition.path) as source:
            source.seek(max(partition.start - 1, 0))
            lines = io.BufferedReader(source, 1 << 20)
            at = partition.start
            if at:
                # the line that the byte before the range belongs to is another range's
                at += len(lines.readline()) - 1
            for document in owned_documents(lines, at, partition.end, at == 0):
                yield partition.path, document.decode("utf-8", "replace")


def owned_documents(lines: Iterable[bytes], at: int, end: int, held: bool) -> Iterator[bytes]:
    """Documents that begin before ``end``, from lines of which the first begins at ``at``; ``held`` if one begins there."""
    document: list[bytes] | None = [] if held else None
    for line in lines:
        if line.startswith(b"# ") and b"\t" not in line:
            if document:
                yield b"".join(document)
            document = [] if at < end else None
        if document is None and at >= end:
            return
        if document is not None:
            document.append(line)
        at += len(line)
    if document:
        yield b"".join(document)


def read_conll(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Sentences of CoNLL files (codigo, sent_idx, tokens, labels); a large file is read in many tasks."""
    spark.dataSource.register(ConllSource)
    blocks = spark.read.format("conll").option("bytes", range_bytes).load(path)
    return parse_blocks(blocks, "path", "text").drop("path")
