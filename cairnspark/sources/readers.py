"""Readers: CSV with messy headers, file families, binary inventories, text lines and table cells of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import numeric_cell


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def detect_column(header: list[str], candidates: list[str]) -> str | None:
    """The header's first candidate by exact name, else by letters and digits alone."""
    for c in candidates:
        if c in header:
            return c
    flat = {re.sub("[^a-z0-9]", "", h.lower()): h for h in reversed(header)}
    return next((flat[k] for c in candidates if (k := re.sub("[^a-z0-9]", "", c.lower())) in flat), None)


def read_csv(spark: SparkSession, path: str, columns: dict[str, list[str]] | None = None, **options) -> DataFrame:
    """A CSV as strings; ``columns`` maps our names to the header's possible ones, absent ones become null columns.

    Duplicate header names get a number, as in ``%``, ``%_2``.
    """
    raw = spark.read.options(header=True, inferSchema=False, multiLine=False, **options).csv(path)
    seen: dict[str, int] = {}
    names = []
    for c in raw.columns:
        base = re.sub(r"(?<=\D)\d+$", "", c) if c not in seen and re.fullmatch(r"%\d+", c) else c
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    raw = raw.toDF(*names)
    if columns is None:
        return raw
    picked = {k: detect_column(raw.columns, v) for k, v in columns.items()}
    return raw.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(k) for k, c in picked.items()])


def family_lines(spark: SparkSession, pattern: str, recursive: bool = False) -> DataFrame:
    """(path, file, first, line): the non-blank lines of all files that a path or pattern finds, and whether a line is its file's first; read by tasks, however many files there are. None found: no rows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where):
        return spark.createDataFrame([], "path string, file string, first boolean, line string")
    text = spark.read.option("recursiveFileLookup", recursive).text(pattern)
    lines = text.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("n"), F.translate("value", "\ufeff", "").alias("line"),
    ).where(F.trim("line") != "")
    # inside a file's first block the numbers rise line by line
    heads = lines.where("start = 0").groupBy("path").agg(F.min_by("line", "n").alias("head_"))
    return lines.join(heads, "path").select("path", "file", (F.col("line") == F.col("head_")).alias("first"), "line")


def _place(header: Column, candidates: list[str]) -> Column:
    """The place (from 1) of the first candidate that a header has by its exact name, else by letters and digits alone; null if it has none."""
    flat = F.transform(header, lambda h: F.regexp_replace(F.lower(h), "[^a-z0-9]", ""))
    exact = [F.array_position(header, c) for c in candidates]
    loose = [F.array_position(flat, re.sub("[^a-z0-9]", "", c.lower())) for c in candidates]
    return F.coalesce(*[F.nullif(x, F.lit(0).cast("long")) for x in exact + loose]).cast("int")


def read_family(spark: SparkSession, pattern: str, columns: dict[str, list[str]], source: str = r"([^/]+?)(?:\.[^.]+)?$", recursive: bool = False, sep: str = ",") -> DataFrame:
    """All CSV files of a family, whatever the order and spelling of their headers, with ``source`` taken from the file's name.

    All files are one scan: tasks find each file's header and where it has the columns, a table of a row for each different header, and cells are taken by place. A column that a file lacks is null there, as is an
    empty cell; a line equal to its file's header is none; no file at all gives an empty frame. Quoted cells stay on one line.
    """
    lines = family_lines(spark, pattern, recursive)
    heads = lines.where("first").select("line").distinct()
    width = heads.agg(F.max(F.size(F.split("line", re.escape(sep))))).first()[0] or 1
    names = [f"c{i}" for i in range(width)]

    def cells(line: Column) -> Column:
        parsed = F.from_csv(line, ", ".join(f"{c} string" for c in names), {"sep": sep})
        return F.array(*[parsed[c] for c in names])

    places = heads.select(F.col("line").alias("head_"), cells(F.col("line")).alias("header_"))
    places = places.select("head_", *[_place(F.col("header_"), v).alias(f"at_{i}") for i, v in enumerate(columns.values())])
    of_file = lines.where("first").select("path", F.col("line").alias("head_")).distinct().join(places, "head_").drop("head_")
    rows = lines.where("not first").join(of_file, "path").withColumn("cells_", cells(F.col("line")))
    name = F.regexp_extract("file", source, 1).alias("source")
    return rows.select(*[F.when(F.col(f"at_{i}").isNotNull(), F.try_element_at("cells_", F.col(f"at_{i}"))).alias(k) for i, k in enumerate(columns)], name)


def reshape(raw: DataFrame, columns: dict[str, list[str]], required: list[str], added: dict[str, str | None]) -> DataFrame:
    """Rows in the canonical columns, trimmed: each from its first possible name in the frame; rows with a blank ``required`` column go; added ones are constant."""
    picked = {k: detect_column(raw.columns, v) for k, v in columns.items()}
    x = raw.select(*[(F.trim(F.col(f"`{c}`").cast("string")) if c else F.lit(None).cast("string")).alias(k) for k, c in picked.items()])
    for c in required:
        x = x.where(F.coalesce(F.col(c), F.lit("")) != "")
    return x.withColumns({k: F.lit(v).cast("string") for k, v in added.items()}) if added else x


def numeric_defaults(raw: DataFrame, key: list[str], columns: dict[str, tuple[list[str], float]]) -> DataFrame:
    """(key, a number for each column): key is the first possible name that is not blank. A column that the frame lacks has its default in every row; a
    row with a blank key, or with a value that is no number, goes."""
    names = [F.nullif(F.trim(F.col(f"`{k}`")), F.lit("")) for k in key if k in raw.columns]
    x, good = raw.withColumn("key_", F.coalesce(*names) if names else F.lit(None).cast("string")), F.col("key_").isNotNull()
    out = []
    for name, (possible, default) in columns.items():
        c = next((c for c in possible if c in raw.columns), None)
        v = F.col(f"`{c}`").cast("string").try_cast("double") if c else F.lit(float(default))
        good = good & v.isNotNull()
        out.append(v.alias(name))
    return x.where(good).select(F.col("key_").alias("key"), *out)


def positional_rows(cells: DataFrame, order: list[str], places: dict[str, int], key: str, pin_from: str | None = None) -> DataFrame:
    """Rows of a table without a usable header: cells by position (from 0), the first row of each key, and a postal code out of one of them.

    cells: (doc, order columns, cells). Rows whose key is blank or no code (it needs a digit) go, such as headers.
    """
    from ..functions.text import code

    x = cells.select("doc", *order, *[F.nullif(F.trim(F.try_element_at("cells", F.lit(i + 1))), F.lit("")).alias(k) for k, i in places.items()])
    x = x.where(F.col(key).rlike("[0-9]"))
    rest = ["doc", *[k for k in places if k != key]]
    first = x.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("doc", *order)).alias("r")).select(key, "r.*")
    return first.withColumn("pin", code(F.col(pin_from))) if pin_from else first


def labelled_rows(cells: DataFrame, label: int, values: dict[str, int], labels: list[str]) -> DataFrame:
    """(doc, value_label for each value and label): a table section with one row for each label, such as Total, Rural, Urban, in any case; its first row counts.

    cells: (doc, row_no, cells).
    """
    from ..functions.text import digits_number

    at = lambda i: F.try_element_at("cells", F.lit(i + 1))
    x = cells.withColumn("label_", F.lower(F.trim(at(label)))).where(F.col("label_").isin([k.lower() for k in labels]))
    agg = [F.min_by(F.when(F.col("label_") == k.lower(), digits_number(at(i))), F.when(F.col("label_") == k.lower(), F.col("row_no"))).alias(f"{v}_{k.lower()}") for v, i in values.items() for k in labels]
    return x.groupBy("doc").agg(*agg)


def literal_table(spark: SparkSession, values: dict, key: str, value: str) -> DataFrame:
    """A mapping of plain values as a frame of two columns; for anchors and lists that come with a model's configuration."""
    kind = {int: "long", float: "double", str: "string", bool: "boolean"}
    k, v = ({type(x) for x in side if x is not None} for side in (values.keys(), values.values()))
    types = [kind[float if ts == {int, float} else next(iter(ts), str)] for ts in (k, v)]
    rows = [(a, float(b) if types[1] == "double" and b is not None else b) for a, b in values.items()]
    return spark.createDataFrame(rows, f"`{key}` {types[0]}, `{value}` {types[1]}")


def load_outputs(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Named result files (CSV with header, or JSON) of a run as cached frames, by their stem; absent ones are left out."""
    found = presence(spark, {n: f"{folder.rstrip('/')}/{n}" for n in names})
    out = {}
    for r in found.where("status = 'PRESENT'").collect():
        stem = r.source.rpartition("/")[2].rpartition(".")[0]
        read = spark.read.option("multiLine", True).json if r.source.endswith(".json") else spark.read.options(header=True, inferSchema=True).csv
        out[stem] = read(r.path).cache()
    return out


def entity_master(rows: DataFrame) -> DataFrame:
    """(entity_id, name, group_id, group_name, census_code): ids as numbers, an empty census code is 0, rows without id go."""
    return rows.select(
        F.col("entity_id").try_cast("long").alias("entity_id"), F.trim("name").alias("name"), F.col("group_id").try_cast("int").alias("group_id"),
        F.trim("group_name").alias("group_name"), F.coalesce(F.col("census_code").try_cast("int"), F.lit(0)).alias("census_code"),
    ).where("entity_id is not null")


def multi_value(c: Column, sep: str = "|") -> Column:
    """A delimited cell as an array of trimmed, non-empty values."""
    return F.filter(F.transform(F.split(c, re.escape(sep)), lambda x: F.trim(x)), lambda x: x != "")


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, extension, bytes, modified, sha16, category, n_rows, n_columns, keys) of a file tree; contents are read on the executors, never gathered.

    n_rows: lines of a CSV that are not blank, less its header; n_columns: of its header; keys: of a JSON object or, at the left margin, of a YAML file.
    """
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    category = F.when(ext.isin("csv", "tsv", "parquet"), "TABLE").when(ext.isin("json", "yaml", "yml"), "CONFIG").when(ext == "pdf", "DOCUMENT").otherwise("OTHER")
    text = F.when(ext.isin("csv", "tsv", "json", "yaml", "yml"), F.decode("content", "UTF-8"))
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    sheet = ext.isin("csv", "tsv")
    columns = F.size(F.split(F.try_element_at(lines, F.lit(1)), F.when(ext == "tsv", "\t").otherwise(",")))
    keys = F.when(ext == "json", F.json_object_keys(text)).when(ext.isin("yaml", "yml"), F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^([A-Za-z_][\w-]*)\s*:", 1)), lambda x: x != ""))
    return files.select(
        "path", ext.alias("extension"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.substring(F.sha2("content", 256), 1, 16).alias("sha16"), category.alias("category"),
        F.when(sheet, F.greatest(F.size(lines) - 1, F.lit(0))).alias("n_rows"), F.when(sheet, F.greatest(columns, F.lit(0))).alias("n_columns"), keys.alias("keys"),
    )


def presence(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """(source, path, n_files, bytes, status) for each named path or pattern, found or not."""
    rows = []
    conf = spark._jsc.hadoopConfiguration()
    for name, pattern in sources.items():
        p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found = p.getFileSystem(conf).globStatus(p)
        files = [f for f in found or [] if f.isFile()]
        rows.append((name, pattern, len(files), sum(f.getLen() for f in files), "PRESENT" if found else "ABSENT"))
    return spark.createDataFrame(rows, "source string, path string, n_files int, bytes long, status string")


def first_present(spark: SparkSession, patterns: list[str]) -> str | None:
    """The first pattern that finds anything."""
    return next((r.path for r in presence(spark, {str(i): p for i, p in enumerate(patterns)}).collect() if r.status == "PRESENT"), None)


def text_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): non-blank trimmed lines, numbered from 1 among all lines."""
    x = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("p", "line"))
    return x.select(key, (F.col("p") + 1).alias("line_no"), F.trim("line").alias("line")).where("line <> ''")


def pdf_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, line_no, text) of PDF files; needs pypdfium2 or pdfplumber on the executors."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.pdf").load(path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        try:
            import pypdfium2

            def pages(data: bytes) -> list[str]:
                return [p.get_textpage().get_text_range() for p in pypdfium2.PdfDocument(data)]
        except ImportError:
            import pdfplumber

            def pages(data: bytes) -> list[str]:
                with pdfplumber.open(io.BytesIO(data)) as pdf:
                    return [p.extract_text() or "" for p in pdf.pages]

        for b in batches:
            for path_, data in zip(b["path"], b["content"]):
                rows = [(path_, n, k, line.strip()) for n, text in enumerate(pages(data), 1) for k, line in enumerate(text.splitlines(), 1) if line.strip()]
                yield pd.DataFrame(rows, columns=["path", "page", "line_no", "text"])

    return files.select("path", "content").mapInPandas(read, "path string, page int, line_no int, text string")


def pdf_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, table_no, row_no, cells) of ruled tables in PDF files; needs pdfplumber on the executors."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.pdf").load(path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pdfplumber

        for b in batches:
            for path_, data in zip(b["path"], b["content"]):
                rows = []
                with pdfplumber.open(io.BytesIO(data)) as pdf:
                    for n, page in enumerate(pdf.pages, 1):
                        for t, grid in enumerate(page.extract_tables(), 1):
                            rows += [(path_, n, t, k, [(c or "").strip() for c in row]) for k, row in enumerate(grid, 1)]
                yield pd.DataFrame(rows, columns=["path", "page", "table_no", "row_no", "cells"])

    return files.select("path", "content").mapInPandas(read, "path string, page int, table_no int, row_no int, cells array<string>")


def facility_rows(cells: DataFrame, order: list[str], width: int, names: list[str]) -> DataFrame:
    """Rows of a ruled table with a group column that is written once and meant for the rows below.

    cells: (doc, order columns, cells). The first cell is the group (carried down inside the document), the second the entity, the rest numbers.
    Header, blank and total rows go.
    """
    from ..operators.sequence import fill_down

    c = F.col("cells")
    x = cells.where(F.size(c) >= width).withColumn("grp_", F.nullif(F.trim(c[0]), F.lit("")))
    x = fill_down(x, "grp_", ["doc"], order, "grp")
    head = F.lower(F.concat_ws(" ", c)).rlike("name of the|state/ut|sr\\.? ?no")
    total = F.lower(F.trim(F.coalesce(c[1], F.lit("")))).isin("", "total", "all india")
    return x.where(~head & ~total).select("doc", "grp", F.trim(c[1]).alias("entity"), *[numeric_cell(c[i + 2]).alias(n) for i, n in enumerate(names)])


def header_map(cells: DataFrame, order: list[str], wanted: dict[str, str]) -> DataFrame:
    """Rows of tables whose header, found by key words, is carried across pages. wanted: name -> regular expression of its header cell."""
    from ..operators.sequence import fill_down

    c = F.transform(F.col("cells"), lambda x: F.lower(x))

    def place(pattern: str) -> Column:
        return F.array_position(F.transform(c, lambda x: x.rlike(pattern)), True).cast("int")

    at = F.struct(*[place(r).alias(k) for k, r in wanted.items()])
    x = cells.withColumn("at_", at)
    full = None
    for k in wanted:
        full = (F.col(f"at_.{k}") > 0) if full is None else full & (F.col(f"at_.{k}") > 0)
    x = x.withColumn("is_head_", full).withColumn("map_", F.when(F.col("is_head_"), F.col("at_")))
    x = fill_down(x, "map_", ["doc"], order, "use_")
    return x.where(~F.col("is_head_") & F.col("use_").isNotNull()).select("doc", *order, *[F.nullif(F.trim(F.try_element_at("cells", F.col(f"use_.{k}"))), F.lit("")).alias(k) for k in wanted])


def key_values(lines: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(doc, label, value): the first line of each document that a label's pattern finds gives its last number."""
    from ..functions.text import last_number

    name = F.lit(None).cast("string")
    for k, r in reversed(labels.items()):
        name = F.when(F.lower("line").rlike(r), F.lit(k)).otherwise(name)
    x = lines.withColumn("label", name).where("label is not null").withColumn("v", last_number(F.col("line"))).where("v is not null")
    return x.groupBy("doc", "label").agg(F.min_by("v", "line_no").alias("value"))


def classify_companies(rows: DataFrame, prefixes: list[str], words: list[str], active: list[str], pin: str = r"\b(\d{6})\b") -> DataFrame:
    """rows (company, status, activity, address) with code and reason: null for those kept, else why a row is excluded; no row is lost."""
    from ..functions.text import code, contains_any

    whole = F.coalesce(F.col("activity").rlike(r"\b(" + "|".join(prefixes) + r")\b"), F.lit(False)) | contains_any(F.col("activity"), words)
    status = F.upper(F.trim(F.coalesce("status", F.lit(""))))
    reason = F.when(~whole, "not in the activity").when((status != "") & ~status.isin(*active), "not active").when(code(F.col("address"), pin).isNull(), "no postal code")
    return rows.withColumn("code", code(F.col("address"), pin)).withColumn("reason", reason)


