"""Small files on any file system, and external sources: CSV manifests, ZIP archives, workbooks."""

from __future__ import annotations

import hashlib
import json
import urllib.request
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from surety.schemas import MANIFEST, ContractError


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else Path(uri).absolute().as_uri())


def read_json(uri: str, default=None):
    from pyarrow import fs

    system, path = file_system(uri)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return default
    with system.open_input_file(path) as f:
        return json.loads(f.read())


def write_json(uri: str, value) -> None:
    """Written beside its place and renamed, so a crash leaves the old or the new state."""
    system, path = file_system(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path + ".new") as f:
        f.write(json.dumps(value, indent=2, sort_keys=True).encode())
    system.move(path + ".new", path)


def list_files(uri: str, prefix: str = "") -> list[str]:
    """URIs of all files below a folder whose names begin with ``prefix``; none if there is no such folder."""
    from pyarrow import fs

    system, path = file_system(uri)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return []
    root = uri if "://" in uri else Path(uri).absolute().as_uri()
    found = [i.path for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File and i.base_name.startswith(prefix)]
    return sorted(root.rstrip("/") + f[len(path.rstrip("/")) :] for f in found)


def file_sha256(uri: str) -> tuple[int, str]:
    """Bytes and SHA-256 of a file, read in pieces."""
    system, path = file_system(uri)
    out, size = hashlib.sha256(), 0
    with system.open_input_stream(path) as f:
        while chunk := f.read(1 << 20):
            out.update(chunk)
            size += len(chunk)
    return size, out.hexdigest()


def file_digests(spark: SparkSession, uris: list[str]) -> DataFrame:
    """(path, bytes, sha256) of the files, each hashed where a task reads it."""

    def digest(batches):
        import pyarrow as pa

        for batch in batches:
            found = [(uri, *file_sha256(uri)) for uri in batch.column(0).to_pylist()]
            yield pa.record_batch({"path": pa.array([x[0] for x in found], pa.string()), "bytes": pa.array([x[1] for x in found], pa.int64()), "sha256": pa.array([x[2] for x in found], pa.string())})

    named = spark.createDataFrame([(u,) for u in uris], "path string")
    return named.repartition(max(1, min(len(uris), 10_000)), "path").mapInArrow(digest, "path string, bytes long, sha256 string")


#: Bytes up to which folders are hashed here instead of by a job of their own.
FEW_BYTES = 16 << 20


def folder_hashes(spark: SparkSession, uris: list[str]) -> dict[str, str | None]:
    """A hash over the bytes of each folder's data files, whatever their names; None without any.

    The files' digests come from the executors, one job for all folders; only they reach the driver.
    """
    from pyarrow import fs

    files = {u: list_files(u, "part-") for u in uris}
    every = sorted({f for found in files.values() for f in found})
    size = 0
    if every:
        system, _ = file_system(every[0])
        size = sum(i.size for i in system.get_file_info([file_system(f)[1] for f in every]) if i.type == fs.FileType.File)
    known = {f: file_sha256(f)[1] for f in every} if size <= FEW_BYTES else {r["path"]: r["sha256"] for r in file_digests(spark, every).collect()}
    return {u: hashlib.sha256("".join(sorted(known[f] for f in found)).encode()).hexdigest() if found else None for u, found in files.items()}


def write_csv(df: DataFrame, uri: str) -> None:
    """A table as CSV with a header; one file where one task can write it."""
    df.write.mode("overwrite").option("header", True).csv(uri)


def write_manifest(spark: SparkSession, folder: str, uri: str) -> list[dict]:
    """Path, bytes and SHA-256 of every file below ``folder``, sorted, as JSON at ``uri``; an empty folder is refused."""
    found = [r.asDict() for r in file_digests(spark, list_files(folder)).orderBy("path").collect()]  # a row a file
    if not found:
        raise ContractError(f"{folder} has no files")
    write_json(uri, {"files": found})
    return found


def provenance(source: str, workbook: str, sheets: list[str], url: str, identifier: str, licence: str) -> dict:
    """Where an external source came from and what it is; it has no ingestion time, and none is claimed."""
    parts = {name: file_sha256(path if "://" in path else Path(path).absolute().as_uri()) for name, path in (("archive", source), ("workbook", workbook))}
    sizes = {f"{name}_{what}": value for name, pair in parts.items() for what, value in zip(("bytes", "sha256"), pair)}
    return {"source_url": url, "identifier": identifier, "license": licence, **sizes, "sheets": sheets, "ingestion_timestamp_available": False, "late_arrival_or_watermark_claimed": False}


def read_manifest(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.csv(uri, header=True, schema=MANIFEST)


def pinned(path: str | Path, size: int, sha256: str) -> None:
    """Refuse a source file that is not the published one."""
    data = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            data.update(chunk)
    if Path(path).stat().st_size != size or data.hexdigest() != sha256:
        raise ContractError(f"{path} is not the pinned source")


def download(url: str, target: str | Path) -> Path:
    """Fetch once, in pieces; an existing file is left alone."""
    target = Path(target)
    if not target.exists():
        part = target.with_name(target.name + ".part")
        with urllib.request.urlopen(url) as source, part.open("wb") as out:
            while chunk := source.read(1 << 20):
                out.write(chunk)
        part.rename(target)
    return target


def extract_workbook(archive: str | Path, folder: str | Path) -> Path:
    """The one workbook of a ZIP archive."""
    with zipfile.ZipFile(archive) as z:
        found = [n for n in z.namelist() if n.lower().endswith(".xlsx")]
        if len(found) != 1:
            raise ContractError(f"expected one workbook, found {found}")
        return Path(z.extract(found[0], folder))


# The column names under which sheets give each canonical column.
ALIASES = {
    "invoice_no": ("Invoice", "InvoiceNo"),
    "stock_code": ("StockCode",),
    "description": ("Description",),
    "quantity": ("Quantity",),
    "invoice_ts": ("InvoiceDate",),
    "unit_price_gbp": ("Price", "UnitPrice"),
    "customer_id": ("Customer ID", "CustomerID"),
    "country": ("Country",),
}
_SPACE = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def resolve_columns(header: list[str]) -> dict[str, int]:
    """Place of every canonical column in a sheet's header."""
    places = {str(h).strip(): i for i, h in enumerate(header)}
    out = {c: next((places[a] for a in names if a in places), None) for c, names in ALIASES.items()}
    if missing := [c for c, i in out.items() if i is None]:
        raise ContractError(f"the sheet lacks {missing}")
    return out


def _cells(row: ET.Element, words: list[str]) -> Iterator[tuple[int, object]]:
    for cell in row.findall("m:c", _SPACE):
        place = 0
        for letter in cell.get("r", "A1"):
            if letter.isalpha():
                place = place * 26 + ord(letter) - 64
        value = cell.find("m:v", _SPACE)
        text = value.text if value is not None else "".join(t.text or "" for t in cell.iterfind(".//m:t", _SPACE))
        kind = cell.get("t")
        yield place - 1, words[int(text)] if kind == "s" else (text if kind in ("str", "inlineStr") else float(text)) if text else None


def workbook_rows(path: str | Path) -> Iterator[tuple]:
    """(sheet, canonical values) of every row of every sheet of an XLSX workbook, read as a stream."""
    with zipfile.ZipFile(path) as z:
        words = []
        if "xl/sharedStrings.xml" in z.namelist():
            words = ["".join(t.text or "" for t in s.iterfind(".//m:t", _SPACE)) for s in ET.parse(z.open("xl/sharedStrings.xml")).getroot()]
        links = {r.get("Id"): r.get("Target") for r in ET.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        for sheet in ET.parse(z.open("xl/workbook.xml")).getroot().iterfind("m:sheets/m:sheet", _SPACE):
            target = links[sheet.get(f"{{{_SPACE['r']}}}id")].lstrip("/").removeprefix("xl/")
            places = None
            for _, element in ET.iterparse(z.open(f"xl/{target}")):
                if element.tag != f"{{{_SPACE['m']}}}row":
                    continue
                cells = dict(_cells(element, words))
                element.clear()
                if places is None:
                    places = resolve_columns([str(cells.get(i, "")) for i in range(max(cells, default=-1) + 1)])
                    continue
                row = {c: cells.get(i) for c, i in places.items()}
                day = row["invoice_ts"]
                row["invoice_ts"] = datetime(1899, 12, 30) + timedelta(days=round(day * 86400) / 86400) if isinstance(day, float) else None
                text = lambda v: None if v is None else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
                number = lambda v: v if isinstance(v, float) else None
                yield (sheet.get("name"), text(row["invoice_no"]), text(row["stock_code"]), text(row["description"]), number(row["quantity"]), row["invoice_ts"], number(row["unit_price_gbp"]), text(row["customer_id"]), text(row["country"]))


def read_workbook(spark: SparkSession, path: str | Path) -> DataFrame:
    """Canonical retail lines of a workbook (a file of bounded size, read on the driver)."""
    from surety.sources.adapters import canonical_lines, customer_id

    schema = "source_row_id long, source_sheet string, invoice_no string, stock_code string, description string, quantity double, invoice_ts timestamp_ntz, unit_price_gbp double, customer_id string, country string"
    lines = spark.createDataFrame([(i, *row) for i, row in enumerate(workbook_rows(path))], schema)
    from pyspark.sql import functions as F

    return canonical_lines(lines.withColumn("customer_id", customer_id(F.col("customer_id"))))
