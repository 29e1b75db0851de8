"""Quarterly text files: find, read, tag, store."""

from functools import reduce

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from oddspark import fixed_values as V
from oddspark.sources.versions import Store
from oddspark.workspace import files_below, first_line, local_table


def below(path: Column, root: str) -> Column:
    """What follows the root in a path or URI, where the root may be given as either."""
    plain = lambda c: F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")
    start = plain(F.lit(root.rstrip("/") + "/"))
    at = F.instr(plain(path), start) + F.length(start)
    return F.substr(plain(path), at)


def quarter_below(path: Column, root: str) -> Column:
    """The quarter of a file: its folder right below the root."""
    return F.substring_index(below(path, root), "/", 1)


def discover_table_files(
    spark: SparkSession, root: str, tables: list[str] = V.RAW_TABLES, suffix: str = ".txt"
) -> DataFrame:
    """Every file of a table below ``root/<quarter>/``: ``table_name, faers_quarter, path``.

    A file belongs to a table when its name is the table's, alone or followed by the digits of a quarter or by a
    mark and the name of a part; letters right behind make another name. A quarter may come in
    several files. A table without a file has no row. The root may be a plain path or a URI. Only
    the listing is read, not the files.
    """
    paths = [{"path": p} for p in files_below(spark, root) if p.endswith(suffix)]
    found = local_table(spark, paths, "path string").withColumn("_file", F.element_at(F.split("path", "/"), -1))
    names = F.filter(F.array(*[F.lit(t) for t in tables]), lambda t: F.startswith(F.col("_file"), t)
                     & ~F.substr(F.col("_file"), F.length(t) + 1, F.lit(1)).rlike(r"^\p{L}"))
    return found.select(
        F.explode(names).alias("table_name"), quarter_below(F.col("path"), root).alias("faers_quarter"), "path")


def scan_delimited(spark: SparkSession, path: str | list[str], sep: str = "$") -> DataFrame:
    """Text with a header line, every column a string.

    Short rows are filled with nulls, surplus cells are dropped, empty cells are null. A quote
    within quotes is doubled, and a backslash is an ordinary character. Column names come from
    the header; nothing is inferred from the rows.
    """
    return (
        spark.read.option("sep", sep)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("inferSchema", False)
        .option("escape", '"')
        .csv(path)
    )


def normalize_columns(df: DataFrame) -> DataFrame:
    """Column names in lower case."""
    return df.toDF(*[c.lower() for c in df.columns])


def tag_source_quarter(df: DataFrame, quarter: str) -> DataFrame:
    """The quarter a row came from."""
    return df.withColumn("faers_quarter", F.lit(quarter))


def type_keys(df: DataFrame) -> DataFrame:
    """Report and case ids as longs, case versions as ints; text that is no number is null."""
    kinds = {"primaryid": "long", "caseid": "long", "caseversion": "int"}
    present = {c: F.col(c).try_cast(kind) for c, kind in kinds.items() if c in df.columns}
    return df.withColumns(present) if present else df


def parse_table(spark: SparkSession, path: str, quarter: str) -> DataFrame:
    """One raw file as a tagged table with lower-case names and typed keys."""
    raw = normalize_columns(scan_delimited(spark, path))
    return tag_source_quarter(type_keys(raw), quarter)


def union_quarters(parts: list[DataFrame]) -> DataFrame:
    """Quarters under each other; a column that a quarter lacks is null there."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def parse_quarters(
    spark: SparkSession, root: str, tables: list[str] = V.RAW_TABLES, suffix: str = ".txt"
) -> dict[str, DataFrame]:
    """Every table found below ``root``, all quarters together.

    The driver sees the paths and header lines, never rows. Files of different quarters may order
    their columns differently, so those with the same header are read in one scan; the quarter of a
    row comes from the path of its file. Files without a header line hold no rows.
    """
    files = files_with_headers(spark, root, tables, suffix)
    return {table.lower(): union_quarters([
        rows.drop("_file", REJECTED) for rows in (scan_files(spark, root, paths) for paths in by_header.values())])
        for table, by_header in files.items()}


def files_with_headers(
    spark: SparkSession, root: str, tables: list[str], suffix: str
) -> dict[str, dict[str, list[str]]]:
    """Per table its header lines, and the paths of the files that begin with each."""
    found = discover_table_files(spark, root, tables, suffix).orderBy("table_name", "faers_quarter", "path")
    headers: dict[str, dict[str, list[str]]] = {}
    for row in found.collect():
        line = first_line(spark, row["path"])
        if line:
            headers.setdefault(row["table_name"], {}).setdefault(line, []).append(row["path"])
    return headers


#: The column that holds the text of a row with too few or too many cells.
REJECTED = "_rejected"


def scan_files(spark: SparkSession, root: str, paths: list[str], sep: str = "$") -> DataFrame:
    """Files with one header in one scan: lower-case names, typed keys, ``faers_quarter``, ``_file``, and
    ``_rejected`` with the text of rows that are short or have surplus cells (such rows are kept as far as
    they go). Files that break off while they are read give the rows before."""
    schema = scan_delimited(spark, paths[:1], sep).schema
    rows = (
        spark.read.schema(schema.add(REJECTED, "string"))
        .option("sep", sep).option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
        .option("columnNameOfCorruptRecord", REJECTED).option("ignoreCorruptFiles", True)
        .csv(paths)
    )
    # File paths come as URIs, in which a plus stands for itself.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    tagged = rows.select("*", quarter_below(path, root).alias("faers_quarter"), path.alias("_file"))
    names = [c if c in (REJECTED, "_file") else c.lower() for c in tagged.columns]
    return type_keys(tagged.toDF(*names))


def profile_files(
    spark: SparkSession, root: str, tables: list[str] = V.RAW_TABLES, suffix: str = ".txt", sep: str = "$"
) -> DataFrame:
    """A row for every file: ``table_name, faers_quarter, file, n_rows, n_columns, first_columns, n_short, n_surplus, status``.

    The status is OK, REJECTS (some rows have too few or too many cells), EMPTY (no header line) or
    UNREADABLE. Files are found by name and counted in one scan per header; none of them stops the others.
    """
    listed = discover_table_files(spark, root, tables, suffix).orderBy("path").collect()
    rows, scans = [], {}
    for file in listed:
        row = {"table_name": file["table_name"].lower(), "faers_quarter": file["faers_quarter"], "file": file["path"]}
        try:
            line = first_line(spark, file["path"])
        except Py4JError:
            rows.append({**row, "status": "UNREADABLE"})
            continue
        if line:
            scans.setdefault(line, []).append(file["path"])
            columns = [c.lower() for c in scan_delimited(spark, file["path"], sep).columns] if len(scans[line]) == 1 else None
        if not line:
            rows.append({**row, "n_rows": 0, "n_columns": 0, "n_short": 0, "n_surplus": 0, "status": "EMPTY"})
        else:
            known = next((r for r in rows if r.get("header") == line), None)
            columns = columns or known["columns"]
            rows.append({**row, "header": line, "columns": columns, "n_columns": len(columns), "first_columns": columns[:10]})
    found = local_table(spark, rows, FILE_PROFILE)
    counts = [_file_counts(scan_files(spark, root, paths, sep), sep) for paths in scans.values()]
    if not counts:
        return found
    counted = reduce(DataFrame.unionByName, counts)
    # Schemes of paths differ between readers.
    plain = lambda c: F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")
    both = found.alias("f").join(counted.alias("c"), plain(F.col("f.file")) == plain(F.col("c._file")), "left")
    number = lambda c: F.when(F.col("f.status") == "UNREADABLE", None).otherwise(F.coalesce(f"c.{c}", f"f.{c}", F.lit(0)))
    status = F.coalesce("f.status", F.when(F.coalesce(F.col("c.n_short") + F.col("c.n_surplus"), F.lit(0)) > 0, "REJECTS"), F.lit("OK"))
    return both.select(
        "f.table_name", "f.faers_quarter", "f.file", number("n_rows").alias("n_rows"), "f.n_columns", "f.first_columns",
        number("n_short").alias("n_short"), number("n_surplus").alias("n_surplus"), status.alias("status"))


FILE_PROFILE = ("table_name string, faers_quarter string, file string, n_rows long, n_columns int, first_columns array<string>, "
                "n_short long, n_surplus long, status string")


def _file_counts(rows: DataFrame, sep: str) -> DataFrame:
    """Rows and rejected rows per file, short ones and those with surplus cells apart."""
    columns = [c for c in rows.columns if c not in (REJECTED, "_file", "faers_quarter")]
    bare = F.regexp_replace(F.col(REJECTED), '"([^"]|"")*"', "")
    cells = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    # Always true, but it has the reader look at all columns: else it doesn't tell rejected rows.
    whole = F.xxhash64(*columns) >= F.lit(-(1 << 63))
    return rows.withColumn("_cells", F.when(whole, cells)).groupBy("_file").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_cells") < len(columns)).alias("n_short"),
        F.count_if(F.col("_cells") > len(columns)).alias("n_surplus"))


def ingest(
    spark: SparkSession, root: str, path: str, tables: list[str] = V.RAW_TABLES, suffix: str = ".txt"
) -> DataFrame:
    """Read every table below ``root`` and store them all by quarter below ``path``, as one new version.

    Returns ``table_name, n_files, n_rows, n_rejected, status`` with a row for every table asked for; the
    status is OK, REJECTS (some rows have too few or too many cells), EMPTY (files without rows)
    or MISSING. Rows are counted while they are written. Tables without files stay as they were stored before.
    """
    files, change = files_with_headers(spark, root, tables, suffix), Store(spark, path).change()
    found = {r[0]: r[1] for r in discover_table_files(spark, root, tables, suffix).groupBy("table_name").count().collect()}
    report = []
    for table in tables:
        row = {"table_name": table.lower(), "n_files": found.get(table, 0), "n_rows": 0, "n_rejected": 0}
        if table in files:
            rows = union_quarters([scan_files(spark, root, paths) for paths in files[table].values()])
            seen = Observation()
            counted = rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count(REJECTED).alias("n_rejected"))
            change.put(table.lower(), counted.drop("_file", REJECTED), by="faers_quarter")
            row.update(seen.get)
        row["status"] = ("MISSING" if not row["n_files"] else "EMPTY" if not row["n_rows"]
                         else "REJECTS" if row["n_rejected"] else "OK")
        report.append(row)
    if change.edits:
        change.commit()
    return local_table(spark, report, "table_name string, n_files int, n_rows long, n_rejected long, status string")


SOURCE_PROFILE = "table_name string, faers_quarter string, n_rows long, n_columns int, first_columns array<string>"


def profile_source(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and the first ten column names per table and quarter.

    Every table is reduced to counts first; the union holds one row per table and quarter. Without
    tables there are no rows.
    """
    if not tables:
        return SparkSession.active().createDataFrame([], SOURCE_PROFILE)
    profiles = []
    for name, df in tables.items():
        columns = [c for c in df.columns if c != "faers_quarter"]
        profiles.append(
            df.groupBy("faers_quarter")
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .select(
                F.lit(name).alias("table_name"),
                "faers_quarter",
                "n_rows",
                F.lit(len(columns)).alias("n_columns"),
                F.array(*[F.lit(c) for c in columns[:10]]).alias("first_columns"),
            )
        )
    return reduce(DataFrame.unionByName, profiles)
