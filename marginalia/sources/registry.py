"""All readers by name, the choice of one for a file, and single-file archives."""

from __future__ import annotations

import re
import zipfile

from pyspark.sql import DataFrame, SparkSession

from marginalia.sources import exports, records

READERS = {
    "ris": records.read_ris, "nbib": records.read_nbib, "wos": records.read_wos, "scopus": records.read_scopus_csv, "lens": records.read_lens_csv, "pubmed": records.read_pubmed_csv, "works": records.read_works_json, "works_pages": records.read_works_pages,
    "thesis_csv": exports.read_thesis_csv, "thesis_ris": exports.read_thesis_ris, "basket_csv": exports.read_basket_csv, "basket_ris": exports.read_basket_ris, "search_csv": exports.read_search_csv,
    "works_csv": exports.read_works_csv, "works_ris": exports.read_works_ris, "works_tagged": exports.read_works_tagged,
}
#: The columns by which a table is known.
SIGNATURES = {
    "scopus": ("EID", "Authors", "Cited by", "Author Keywords"), "lens": ("Lens ID", "Title", "Publication Year", "Citing Works Count"), "pubmed": ("PMID", "Title", "Authors", "Journal/Book"),
    "thesis_csv": ("Autor(a)", "Orientadores", "Título", "Ano de defesa", "Instituição de defesa", "Sigla da instituição de defesa", "Tipo de documento", "Link de acesso"),
    "basket_csv": ("ID", "CLASS", "YEAR", "PUBLICATION", "AUTHORS", "TITLE", "KEYWORDS", "ABSTRACTS", "SESSION", "LEGEND", "URL"),
    "search_csv": ("title", "publicationDate", "authors", "plink", "longDbName", "shortDbName", "accessionNumber", "source"),
}
DECLARED_LEAST, OTHER_SURE, ANY_LEAST = 0.3, 0.8, 0.5
ARCHIVED = ("csv", "txt", "ris", "nbib", "json", "jsonl", "xls")
MAX_ARCHIVED = 2**30
SAMPLE_BYTES = 256 * 1024
#: How OLE2 and ZIP files begin.
BINARY = (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"PK\x03\x04")


def first_bytes(spark: SparkSession, path: str, n: int = SAMPLE_BYTES) -> bytes:
    """The first n bytes of a file, or of a folder's first file, wherever Spark can read it."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.getFileStatus(at)
    if found.isDirectory():
        inner = sorted((x for x in fs.listStatus(at) if x.isFile() and not x.getPath().getName().startswith(("_", "."))), key=lambda x: x.getPath().getName())
        if not inner:
            return b""
        found = inner[0]
    stream = fs.open(found.getPath())
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, found.getLen())))
    finally:
        stream.close()


def is_utf8(sample: bytes, cut: bool = False) -> bool:
    """UTF-8 without zero bytes; a character that the sample's end cuts through doesn't count. UTF-16 marks are no UTF-8."""
    if sample[:2] in (b"\xff\xfe", b"\xfe\xff") or b"\0" in sample:
        return False
    for less in range(4 if cut else 1):
        try:
            sample[: len(sample) - less].decode()
            return True
        except UnicodeDecodeError:
            pass
    return False


def check_encoding(spark: SparkSession, path: str) -> None:
    """ValueError for text in another encoding than UTF-8; spreadsheets and archives are no text."""
    sample = first_bytes(spark, path)
    if not sample.startswith(BINARY) and not is_utf8(sample, len(sample) == SAMPLE_BYTES):
        raise ValueError(f"{path} isn't UTF-8: save it again in that encoding")


def scores(spark: SparkSession, path: str) -> dict[str, float]:
    """How well each reader fits the beginning of a file."""
    head = first_bytes(spark, path).decode("utf-8", "replace").lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")[:400]
    text = "\n".join(head)
    columns = {c.strip().strip('"').strip() for c in (head[0] if head else "").split(",")}
    out = {k: len(columns & set(v)) / len(v) for k, v in SIGNATURES.items()}
    low = {c.lower() for c in columns}
    known = sum(bool(low & set(v)) for v in exports.WORKS_COLUMNS.values())
    if "work id" in low or ("id" in low and "openalex.org/W" in text):
        out["works_csv"] = float(known >= 4)
    elif {"citation count", "open access", "author", "year"} <= low or {"cited_by_count", "publication_year"} <= low:
        out["works_csv"] = 0.9  # it may lack an id and a DOI: the reader says so
    tags = [x[:2] for x in head if x[2:5] == "  -"]
    if "TY" in tags:
        kinds = {x[5:].strip() for x in head if x.startswith("TY  -")}
        links = [x[5:].strip() for x in head if x.startswith("UR  -")]
        out["ris"] = 0.55
        out["thesis_ris"] = float(kinds <= set(exports.THESIS_TYPES))
        out["basket_ris"] = float(any(x.startswith(exports.BASKET_HANDLE) for x in links))
        works = ("AU", "C1") in zip(tags, tags[1:]) and not {"AN", "DB", "JF", "JO", "M3"} & set(tags) and all(x.startswith("https://doi.org/") for x in links)
        out["works_ris"] = 0.7 * works
    out["nbib"] = float(any(x.startswith("PMID- ") for x in head))
    if any(x.startswith("PT ") for x in head):
        out["wos"], out["works_tagged"] = 0.9, float(any(x.startswith("FN OpenAlex") for x in head))
    start = text.lstrip()
    page = start.startswith("[") or start.rstrip() == "{" or bool(re.match(r'\{\s*"(meta|results|group_by)"', start))
    out["works"], out["works_pages"] = float(start.startswith("{") and not page), float(page)
    return out


def detect(spark: SparkSession, path: str, declared: str | None = None) -> str | None:
    """The declared reader, unless it fits badly and another one surely; else the one that fits best, or None."""
    fit = scores(spark, path)
    best = max(fit, key=fit.get)
    if declared:
        return best if fit.get(declared, 0) < DECLARED_LEAST and fit[best] >= OTHER_SURE else declared
    return best if fit[best] > ANY_LEAST else None


def read(spark: SparkSession, path: str, declared: str | None = None) -> DataFrame:
    """The records of a file; ValueError if no reader fits it or it isn't UTF-8."""
    check_encoding(spark, path)
    if (name := detect(spark, path, declared)) is None:
        raise ValueError(f"no reader fits {path}")
    return READERS[name](spark, path)


def unpack(archive: str, folder: str) -> str:
    """The path of the one file of an uploaded archive, unpacked into the folder, which all executors must see.
    ValueError for more files, other kinds or too large ones. It runs where the upload lies, before Spark."""
    with zipfile.ZipFile(archive) as z:
        inner = [i for i in z.infolist() if not i.is_dir() and not i.filename.startswith("__MACOSX/")]
        if len(inner) != 1:
            raise ValueError("an archive must hold one file")
        one = inner[0]
        if one.filename.rsplit(".", 1)[-1].lower() not in ARCHIVED or one.file_size > MAX_ARCHIVED:
            raise ValueError(f"{one.filename} can't be read")
        one.filename = one.filename.replace("\\", "/").rsplit("/", 1)[-1]
        return z.extract(one, folder)
