"""Writers. Tables are Spark's; side files of a few rows are written by the driver."""

from __future__ import annotations

import csv
import gzip
import io
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetra.operators.checks import strict_json


def normal(df: DataFrame) -> DataFrame:
    """All columns as text: null is empty, booleans are lower-case."""
    return df.select(*[F.coalesce(F.lower(F.col(c).cast("string")) if t == "boolean" else F.col(c).cast("string"), F.lit("")).alias(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, extras: str = "ignore", mode: str = "errorifexists", one_file: bool = False) -> None:
    """The given fields as CSV with a header. Columns beyond them are left out, or fail if extras is 'raise'; a file that is there fails. one_file: by one task, for small tables."""
    fields = fields or df.columns
    if extras == "raise" and (more := [c for c in df.columns if c not in fields]):
        raise ValueError(f"columns without a field: {more}")
    out = normal(df.select(*fields))
    (out.coalesce(1) if one_file else out).write.mode(mode).option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path, header=True)


def csv_bytes(df: DataFrame, most: int = 1_000_000) -> bytes:
    """A small table as CSV bytes, on the driver; more rows than `most` fail."""
    rows = normal(df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    text = io.StringIO(newline="")
    writer = csv.writer(text, lineterminator="\r\n")
    writer.writerow(df.columns)
    writer.writerows(rows)
    return text.getvalue().encode()


def gzip_bytes(data: bytes) -> bytes:
    """gzip without a time or a name, so equal data gives equal bytes."""
    out = io.BytesIO()
    with gzip.GzipFile(filename="", mode="wb", fileobj=out, compresslevel=9, mtime=0) as f:
        f.write(data)
    return out.getvalue()


def write_atomic(path: str, data: bytes, exclusive: bool = False) -> None:
    """Writes beside the path, syncs, then renames: readers see all or nothing. A file that is there fails if exclusive."""
    if exclusive and os.path.exists(path):
        raise FileExistsError(path)
    with tempfile.NamedTemporaryFile(dir=os.path.dirname(path) or ".", delete=False) as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def absent(paths: list[str]) -> None:
    if there := [p for p in paths if os.path.exists(p)]:
        raise FileExistsError(f"there already: {there}")


def json_bytes(value: object) -> bytes:
    """Canonical JSON with a line feed; numbers that aren't finite fail."""
    return (strict_json(value) + "\n").encode()


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON lines with sorted keys, nulls included."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def markdown(title: str, sections: dict[str, DataFrame], most: int = 200) -> str:
    """A report: each table's first rows, at most so many; a table that has more says so."""
    out = [f"# {title}"]
    for name, df in sections.items():
        found = df.limit(most + 1).collect()
        rows = [["" if v is None else str(v).replace("|", "\\|") for v in r] for r in found[:most]]
        out += ["", f"## {name}", "", f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}", *[f"| {' | '.join(r)} |" for r in rows]]
        out += ["", f"The first {most} of {df.count()} rows."] if len(found) > most else []
    return "\n".join(out) + "\n"
