"""Log files in text, JSON, JSON-lines and CSV form.

Every reader yields *raw rows*: ``source_file``, ``line_number``, then ``line`` for
a text log or the field map ``fields`` with the numeric timestamps ``seconds`` for
the others and, for a record that cannot be read, its text ``raw`` with a ``reason``.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.json_text import is_json
from faultline.functions.text import strip
from faultline.plans.cut import cut
from faultline.plans.joins import lookup_join
from faultline.schema import CSV_EXTENSIONS, JSON_EXTENSIONS, TEXT_EXTENSIONS, TIMESTAMP_KEYS
from faultline.sources.fragments import csv_records, fragments, json_documents
from faultline.sources.numbering import number_records

_FIELDS = "map<string,string>"
_SECONDS = "map<string,double>"
_NUMBER = r"^-?[0-9][0-9.eE+\-]*$"


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def extension_glob(extensions: Sequence[str]) -> str:
    """A file-name glob for some extensions, in any letter case."""
    names = ["".join(f"[{c}{c.upper()}]" for c in ext) for ext in extensions]
    return "*.{" + ",".join(names) + "}"


def list_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Path, size and lower-case extension of every file; contents stay unread."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(list(paths))
        .select(
            F.col("path").alias("source_file"),
            F.col("length").alias("bytes"),
            F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"),
        )
    )


def hidden_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Files below ``paths`` that Spark's readers pass over for a leading dot or underscore.

    The listing is walked on the driver; only such names are held.
    """
    jvm, found = spark._jvm, []
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        root = jvm.org.apache.hadoop.fs.Path(path)
        system = root.getFileSystem(conf)
        for top in system.globStatus(root) or []:
            entries = system.listFiles(top.getPath(), True)
            while entries.hasNext():
                file = entries.next().getPath().toString()
                below = file[len(top.getPath().getParent().toString()) :] if top.getPath().getParent() else file
                if any(part[:1] in ("_", ".") for part in below.split("/") if part):
                    found.append(file)
    return found


def present_paths(
    spark: SparkSession, paths: Sequence[str], strict: bool = False
) -> tuple[list[str], list[str]]:
    """Split the given paths into those that exist and those that do not."""
    found, missing = [], []
    for path in paths:
        try:
            spark.read.text(path)
            found.append(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            if strict:
                raise FileNotFoundError(path) from error
            missing.append(path)
    return found, missing


def _by_extension(spark: SparkSession, extensions: Sequence[str]) -> DataFrameReader:
    return spark.read.option("pathGlobFilter", extension_glob(extensions)).option(
        "recursiveFileLookup", True
    )


# ---------------------------------------------------------------------------
# Text
# ---------------------------------------------------------------------------


def text_lines(
    spark: SparkSession, paths: Sequence[str], extensions: Sequence[str] = TEXT_EXTENSIONS
) -> DataFrame:
    """Stripped non-blank lines with their physical line number."""
    scan = _by_extension(spark, extensions).text(list(paths))
    numbered = number_records(scan)
    return numbered.withColumn("value", strip(F.col("value"))).filter(F.col("value") != "")


def raw_text(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return text_lines(spark, paths).select(
        "source_file",
        "line_number",
        F.col("value").alias("line"),
        _null(_FIELDS).alias("fields"),
        _null(_SECONDS).alias("seconds"),
        _null("string").alias("raw"),
        _null("string").alias("reason"),
    )


# ---------------------------------------------------------------------------
# JSON
# ---------------------------------------------------------------------------


def json_seconds(text: Column, fields: Column) -> Column:
    """Numbers under a timestamp key; the text is read again only if one looks so."""
    numeric = T.StructType([T.StructField(k, T.DoubleType()) for k in TIMESTAMP_KEYS])
    looks = reduce(
        lambda a, b: a | b,
        [
            F.coalesce(F.try_element_at(fields, F.lit(k)).rlike(_NUMBER), F.lit(False))
            for k in TIMESTAMP_KEYS
        ],
    )
    read = F.from_json(text, numeric)
    pairs = F.create_map(
        *[part for k in TIMESTAMP_KEYS for part in (F.lit(k), read.getField(k))]
    )
    return F.when(looks, pairs)


def json_object(text: Column) -> Column:
    """The field map if the whole text is one JSON object, else null; of a repeated key the last value counts.

    Read inside an object and measured inside an array: matter after the end of
    the object breaks one of the two.
    """
    wrapped = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"v {_FIELDS}")["v"]
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    # Bound to a name of its own, the map is read once and not at each place that asks for it.
    return F.when(text.startswith("{") & alone, F.get(F.transform(F.array(wrapped), last_of_each_key), F.lit(0)))


def last_of_each_key(fields: Column) -> Column:
    """A map read from JSON, which may hold a key twice, with the last value of each key."""
    keys, entries = F.map_keys(fields), F.map_entries(fields)
    later = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.map_from_entries(later)).otherwise(fields)


def _json_rows(elements: DataFrame) -> DataFrame:
    """Raw rows of JSON texts that should each be one object."""
    text = F.col("element")
    good = F.col("fields").isNotNull()
    # Made by a generator, which filters on the reason don't pass: each text is read once.
    read = elements.select("*", F.inline(F.array(F.struct(json_object(text).alias("fields")))))
    return read.select(
        "source_file",
        "line_number",
        _null("string").alias("line"),
        "fields",
        F.when(good, json_seconds(text, F.col("fields"))).alias("seconds"),
        F.when(~good, text).alias("raw"),
        F.when(~good, F.when(is_json(text), "not a JSON object").otherwise("invalid JSON")).alias(
            "reason"
        ),
    )


def json_array(text: Column) -> Column:
    return F.from_json(text, T.ArrayType(T.StringType()))


def document_elements(parts: DataFrame) -> DataFrame:
    """Parts of JSON documents as (source_file, line_number, elements, valid).

    An array's first part begins with a bracket, each further one with a comma, and the last ends with a bracket.
    """
    text, number, last, inner, listed = (F.col(c) for c in ("_text", "number", "last", "_inner", "_listed"))
    first, nothing = number == 1, F.lit("")
    # What is left without the opening mark and, in the last part, without the bracket at its end.
    begin = F.when(first | text.startswith(","), 2).otherwise(1)
    own = strip(F.substring(text, begin, F.length(text) - begin + F.when(last, 0).otherwise(1)))
    staged = (
        parts.withColumn("_text", strip(F.col("text")))
        .withColumn("_inner", F.when(F.col("base") == 1, own))
        .withColumn("_one", inner.startswith("{") & ~last)
        .withColumn("_listed", F.concat(F.lit("["), inner, F.lit("]")))
    )
    opened = F.when(first, text.startswith("[")).otherwise(text.startswith(",") | (last & (text == "]")))
    closed = ~last | text.endswith("]")
    may_be_empty = last & ~text.startswith(",")
    one = F.col("_one")
    none = F.array().cast("array<string>")
    in_array = F.struct(
        F.when(one, F.array(inner)).when(inner == "", none).otherwise(json_array(listed)).alias("elements"),
        (opened & closed & F.when(inner == "", may_be_empty).otherwise(is_json(F.when(one, inner).otherwise(listed)))).alias(
            "valid"
        ),
    )
    whole_end = (number == 2) & (text == "") & ((F.col("text") != nothing) | F.col("ends_closed"))
    alone = F.struct(
        F.when(last, none).otherwise(F.array(text)).alias("elements"),
        F.when(last, whole_end).otherwise(first & is_json(text)).alias("valid"),
    )
    read = staged.withColumn("_read", F.when(F.col("base") == 1, in_array).otherwise(alone))
    return read.select("source_file", "number", "last", "_read.elements", F.coalesce("_read.valid", F.lit(False)).alias("valid"))


def raw_json(spark: SparkSession, paths: Sequence[str], extensions: Sequence[str] = JSON_EXTENSIONS) -> DataFrame:
    """Objects of JSON documents and of JSON-lines files.

    ``.jsonl`` files are read by lines, always. Any other file is one document if it is one valid array or object, of
    whatever size and on however many lines: it is cut at closing braces, and tasks read its blocks side by
    side. A file that is no valid document is read by lines; a line that is no object is then a
    bad record of its own. Elements of an array are numbered by place; values between its objects that are none
    themselves bear the number of the object behind them.
    """
    by_nature = [e for e in extensions if e.lower() == "jsonl"]
    others = [e for e in extensions if e.lower() != "jsonl"]
    lines = [text_lines(spark, paths, by_nature)] if by_nature else []
    found: list[DataFrame] = []
    if others:
        scan = _by_extension(spark, others).option("lineSep", "}").text(list(paths))
        parts, no_documents = json_documents(fragments(scan))
        # Asked twice, for files with a flaw and for the elements of the others.
        read = cut(document_elements(parts))
        spoilt = cut(read.filter(~F.col("valid")).select("source_file").distinct())
        place = F.col("number") + F.when(F.col("last"), F.col("_at")).otherwise(0)
        found.append(
            lookup_join(read, spoilt, ["source_file"], "left_anti")
            .select("source_file", "number", "last", F.posexplode("elements").alias("_at", "element"))
            .select("source_file", place.cast("long").alias("line_number"), "element")
        )
        # As many names as a listing of the folder has.
        by_line = [r.source_file for r in no_documents.unionByName(spoilt).toLocalIterator()]
        if by_line:
            lines.append(text_lines(spark, [_plain_path(f) for f in by_line], others))
    found += [rows.select("source_file", "line_number", F.col("value").alias("element")) for rows in lines]
    return _json_rows(reduce(DataFrame.unionByName, found))


# ---------------------------------------------------------------------------
# CSV
# ---------------------------------------------------------------------------


def csv_headers(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, bool], list[str]]:
    """Files by header line and by whether a quoted cell goes on over a line break.

    Holds one short line per file, as a file listing does. A line with an odd number
    of quotes begins or ends such a cell.
    """
    scan = _by_extension(spark, CSV_EXTENSIONS).text(list(paths))
    text = strip(F.col("value"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    leads = (F.col("_metadata.file_block_start") == 0) & (text != "")
    heads = scan.select(
        F.col("_metadata.file_path").alias("source_file"),
        F.monotonically_increasing_id().alias("at"),
        F.when(leads, text).alias("value"),
        (quotes % 2 == 1).alias("odd"),
    )
    found = heads.groupBy("source_file").agg(
        F.min(F.when(F.col("value").isNotNull(), F.struct("at", "value"))).getField("value").alias("header"),
        F.bool_or("odd").alias("broken"),
    )
    groups: dict[tuple[str, bool], list[str]] = {}
    for row in found.filter("header is not null").toLocalIterator():
        groups.setdefault((row.header, bool(row.broken)), []).append(row.source_file)
    return groups


def raw_csv(spark: SparkSession, paths: Sequence[str], multi_line: bool | None = None) -> DataFrame | None:
    """Records of CSV files, one scan per distinct header.

    Files in which a quoted cell holds a line break are put together from their lines, blocks side by side; the
    others are plain scans. ``multi_line`` decides for all files.
    """
    scans, broken = [], []
    for (header, breaks), files in sorted(csv_headers(spark, paths).items()):
        if breaks if multi_line is None else multi_line:
            broken += files
        else:
            scans.append(_csv_group(spark, header, files))
    if broken:
        scans += _csv_over_lines(spark, broken)
    return reduce(DataFrame.unionByName, scans) if scans else None


def column_names(header: str) -> list[str]:
    """Names of a header line; empty ones by place, repeated ones with a number behind them."""
    names: list[str] = []
    for place, name in enumerate(next(csv.reader(header.splitlines(keepends=True)))):
        own = name or f"_c{place}"
        times = 0
        while own in names:
            times += 1
            own = f"{name or f'_c{place}'}.{times}"
        names.append(own)
    return names


CSV_OPTIONS = {
    "escape": '"',
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_text",
    # Else cells that no one asks for are not counted.
    "columnPruning": "false",
}


def csv_cells(names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]


def csv_schema(names: Sequence[str]) -> T.StructType:
    """Cells by place, and the text of a record with more or fewer cells than the header, which Spark keeps."""
    return T.StructType([*csv_cells(names), T.StructField("_text", T.StringType())])


def csv_rows(numbered: DataFrame, names: Sequence[str]) -> DataFrame:
    """Raw rows of records read by ``csv_schema`` that know their source_file and line_number."""
    fields = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"c{i}") for i in range(len(names))])
    )
    wide = T.StructType([*csv_cells(names), T.StructField("_surplus", T.StringType())])
    read = F.from_csv("_text", wide.simpleString()[7:-1].replace(":", " "), {"escape": '"', "multiLine": "true"})
    # Spark refuses a scan of the record text alone; no length is negative.
    never = F.length("c0") < 0
    good = F.col("_text").isNull() | read["_surplus"].isNull() | F.coalesce(never, F.lit(False))
    seconds = F.create_map(
        *[
            part
            for k in TIMESTAMP_KEYS
            for part in (
                F.lit(k),
                F.when(
                    F.try_element_at(F.col("fields"), F.lit(k)).rlike(_NUMBER),
                    F.try_element_at(F.col("fields"), F.lit(k)).try_cast("double"),
                ),
            )
        ]
    )
    return numbered.withColumn("fields", fields).select(
        "source_file",
        "line_number",
        _null("string").alias("line"),
        F.when(good, F.col("fields")).alias("fields"),
        F.when(good, seconds).alias("seconds"),
        F.when(~good, F.col("_text")).alias("raw"),
        F.when(~good, "more fields than the header").alias("reason"),
    )


def _csv_group(spark: SparkSession, header: str, files: Sequence[str]) -> DataFrame:
    names = column_names(header)
    reader = spark.read.schema(csv_schema(names)).options(**CSV_OPTIONS, header=True, enforceSchema=True)
    # File names from the metadata column are URIs; a path needs them decoded.
    scan = reader.csv([_plain_path(f) for f in files])
    return csv_rows(number_records(scan), names)


def _csv_over_lines(spark: SparkSession, files: Sequence[str]) -> list[DataFrame]:
    """Raw rows of files whose records go on over lines, by header; each is read by as many tasks as it has splits."""
    scan = _by_extension(spark, CSV_EXTENSIONS).option("lineSep", "\n").text([_plain_path(f) for f in files])
    rows = csv_records(fragments(scan))
    heads: dict[str, list[str]] = {}
    for row in rows.filter("number = 1").toLocalIterator():
        heads.setdefault(row.text, []).append(row.source_file)
    found = []
    for header, own in sorted(heads.items()):
        names = column_names(header)
        named = spark.createDataFrame([(f,) for f in own], "source_file string")
        body = lookup_join(rows.filter("number > 1"), named, ["source_file"], "left_semi")
        kinds = csv_schema(names).simpleString()[7:-1].replace(":", " ")
        read = F.from_csv("text", kinds, {**CSV_OPTIONS, "multiLine": "true"}).alias("_cells")
        cells = body.select("source_file", (F.col("number") - 1).alias("line_number"), read).select(
            "source_file", "line_number", "_cells.*"
        )
        found.append(csv_rows(cells, names))
    return found


def _plain_path(uri: str) -> str:
    """The path of a file URI: percent escapes undone, and glob characters taken as they are."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(uri))


# ---------------------------------------------------------------------------
# All formats
# ---------------------------------------------------------------------------


def raw_rows(
    spark: SparkSession,
    paths: Sequence[str],
    strict: bool = False,
    multi_line_csv: bool | None = None,
) -> DataFrame:
    """Raw rows of all files below ``paths``, each read by its extension.

    With ``strict`` a missing path or an unknown extension is an error. Without,
    both become rows with a reason, and everything else is still read.
    """
    found, missing = present_paths(spark, paths, strict)
    parts: list[DataFrame] = []
    if found:
        supported = TEXT_EXTENSIONS + JSON_EXTENSIONS + CSV_EXTENSIONS
        files = list_files(spark, found)
        kinds = {row.extension for row in files.select("extension").distinct().toLocalIterator()}
        unknown = kinds - set(supported)
        if unknown and strict:
            raise ValueError(f"unsupported log formats: {sorted(unknown)}")
        if kinds & set(TEXT_EXTENSIONS):
            parts.append(raw_text(spark, found))
        if kinds & set(JSON_EXTENSIONS):
            parts.append(raw_json(spark, found))
        if kinds & set(CSV_EXTENSIONS):
            tables = raw_csv(spark, found, multi_line_csv)
            if tables is not None:
                parts.append(tables)
        if hidden := [f for f in hidden_files(spark, found) if not f.endswith((".crc", "/_SUCCESS"))]:
            if strict:
                raise ValueError(f"hidden files are not read: {hidden}")
            names = spark.createDataFrame([(h,) for h in hidden], "source_file string")
            parts.append(_reported(names, "hidden file name"))
        if unknown:
            parts.append(
                _reported(
                    files.filter(~F.col("extension").isin(supported)).select("source_file"),
                    "unsupported format",
                )
            )
    if missing or not parts:
        names = spark.createDataFrame([(m,) for m in missing], "source_file string")
        parts.append(_reported(names, "file not found"))
    return reduce(DataFrame.unionByName, parts)


def _reported(files: DataFrame, reason: str) -> DataFrame:
    return files.select(
        "source_file",
        _null("long").alias("line_number"),
        _null("string").alias("line"),
        _null(_FIELDS).alias("fields"),
        _null(_SECONDS).alias("seconds"),
        _null("string").alias("raw"),
        F.lit(reason).alias("reason"),
    )
