"""What an input must be before anything reads it: addresses that may be fetched, archives that may be opened."""

from __future__ import annotations

import io
import ipaddress
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit, urlunsplit
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Hosts and addresses that are never fetched, limits, and the names that make an office document.
BLOCKED = {"localhost", "localhost.localdomain", "metadata", "metadata.google.internal", "instance-data"}
METADATA = {ipaddress.ip_address("169.254.169.254"), ipaddress.ip_address("100.100.100.200")}
ENTRIES, ENTRY_BYTES, TOTAL_BYTES, RATIO, RATIO_FROM = 10_000, 50 << 20, 400 << 20, 100.0, 1 << 20
XML_BYTES = 2 << 20
_MAIN = "application/vnd.openxmlformats-officedocument.{}.main+xml"
DOCUMENTS = {
    _MAIN.format("wordprocessingml.document"): ("word/document.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    _MAIN.format("presentationml.presentation"): ("ppt/presentation.xml", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
}


def public_address(address: str, private_too: bool = False) -> bool:
    """Whether an address may be fetched from."""
    try:
        ip = ipaddress.ip_address(address.partition("%")[0])
    except ValueError:
        return False
    never = ip in METADATA or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_unspecified or ip.is_reserved
    return not never and (private_too or (ip.is_global and not ip.is_private))


def checked_url(url: str | None, addresses: list[str] | None = None, private_too: bool = False) -> dict:
    """{error, url, host}: the first rule that a source URL breaks, or its plain form. addresses: what the host resolves to,
    all of which must be public."""
    fail = lambda code: {"error": code, "url": None, "host": None}
    try:
        parts = urlsplit((url or "").strip())
        port, name = parts.port, parts.hostname
    except ValueError:
        return fail("invalid_source_url")
    if not (url or "").strip():
        return fail("invalid_source_url")
    if parts.scheme.lower() not in ("http", "https"):
        return fail("invalid_source_url_scheme")
    if not name:
        return fail("invalid_source_url")
    if parts.username is not None or parts.password is not None:
        return fail("source_url_credentials_forbidden")
    host = name.rstrip(".").lower()
    if host in BLOCKED or host.endswith(".localhost"):
        return fail("source_url_blocked")
    try:
        host = host.encode("idna").decode("ascii")
    except UnicodeError:
        return fail("invalid_source_url")
    try:
        known = [str(ipaddress.ip_address(host))]
    except ValueError:
        known = addresses
    if known is not None and not known:
        return fail("source_url_dns_failed")
    if not all(public_address(a, private_too) for a in known or ()):
        return fail("source_url_blocked")
    place = f"[{host}]" if ":" in host else host
    return {"error": None, "url": urlunsplit((parts.scheme.lower(), place if port is None else f"{place}:{port}", parts.path or "/", parts.query, "")), "host": host}


@F.arrow_udf(StructType([StructField(n, StringType()) for n in ("error", "url", "host")]))
def source_url(url: pa.Array, addresses: pa.Array) -> pa.Array:
    """The policy for URLs; addresses is null where they are not known yet, as before a look-up."""
    kind = pa.struct([("error", pa.string()), ("url", pa.string()), ("host", pa.string())])
    return pa.array([checked_url(u, a) for u, a in zip(url.to_pylist(), addresses.to_pylist(), strict=True)], kind)


def zip_entries(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, ord, name, size, packed, encrypted) of the entries of archives; one row with a null name where one can not be read.
    Only the directory is read, nothing is unpacked."""
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, data in zip(pdf[key], pdf[content], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                        out += [(k, i, m.filename, m.file_size, m.compress_size, bool(m.flag_bits & 1)) for i, m in enumerate(z.infolist())] or [(k, 0, "", 0, 0, False)]
                except (zipfile.BadZipFile, OSError, ValueError, TypeError):
                    out.append((k, 0, None, None, None, None))
            yield pd.DataFrame(out, columns=[key, "ord", "name", "size", "packed", "encrypted"]).astype(object)

    return files.select(key, content).mapInPandas(run, f"{key} {kind}, ord long, name string, size long, packed long, encrypted boolean")


def archive_errors(entries: DataFrame, key: str) -> DataFrame:
    """(key, error): the first unsafe entry of each archive and the first rule it breaks, or null."""
    so_far = F.sum("size").over(Window.partitionBy(key).orderBy("ord"))
    rules: list[tuple[str, Column]] = [
        ("invalid_ooxml", F.col("name").isNull()),
        ("archive_path_traversal", F.col("name").startswith("/") | F.col("name").contains("\\") | F.array_contains(F.split("name", "/"), "..")),
        ("archive_encrypted_entry", F.col("encrypted")),
        ("archive_entry_too_large", F.col("size") > ENTRY_BYTES),
        ("archive_too_large", F.col("total") > TOTAL_BYTES),
        ("archive_suspicious_ratio", (F.col("size") > RATIO_FROM) & (F.col("size") / F.greatest(F.lit(1), F.col("packed")) > RATIO)),
    ]
    rows = entries.withColumn("total", so_far).withColumn("code", F.coalesce(*(F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules)))
    first = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by("code", F.when(F.col("code").isNotNull(), F.col("ord"))).alias("code"))
    return first.select(key, F.when(F.col("n") > ENTRIES, "archive_too_many_entries").otherwise(F.col("code")).alias("error"))


def _resolved(owner: str, target: str) -> str | None:
    """Where a relationship leads inside the archive; null if it leads out of it."""
    plain = unquote(unquote(target))  # what is escaped twice is still found
    path = plain.replace("\\", "/")
    if "\x00" in plain or path.startswith("/"):
        return None
    place = posixpath.normpath(posixpath.join(owner, path))
    return None if place == ".." or place.startswith("../") else place


def _owner(name: str) -> list[str]:
    parts = name.split("/")
    return parts[: parts.index("_rels")] if "_rels" in parts else parts[:-1]


def relationships(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, part, ord, rel_id, type, external, target, resolved, error) of all relationships of office documents; archives must have
    passed archive_errors."""
    kind = dict(files.dtypes)[key]
    names = [key, "part", "ord", "rel_id", "type", "external", "target", "resolved", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, data in zip(pdf[key], pdf[content], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    for part in sorted(n for n in z.namelist() if n.endswith(".rels")):
                        raw = z.read(part)
                        try:
                            root = ElementTree.fromstring(raw) if len(raw) <= XML_BYTES else None
                        except ElementTree.ParseError:
                            root = None
                        if root is None:
                            out.append((k, part, 0, None, None, None, None, None, "invalid_ooxml"))
                            continue
                        for i, r in enumerate(root):
                            a = r.attrib
                            external = a.get("TargetMode", "").casefold() == "external"
                            place = _resolved("/".join(_owner(part)), a.get("Target", ""))
                            error = "ooxml_external_relationship" if external else "archive_path_traversal" if place is None else None
                            out.append((k, part, i, a.get("Id"), a.get("Type"), external, a.get("Target"), place, error))
            yield pd.DataFrame(out, columns=names).astype(object)

    return files.select(key, content).mapInPandas(run, f"{key} {kind}, part string, ord long, rel_id string, type string, external boolean, target string, resolved string, error string")


def office_identity(content: bytes) -> dict:
    """{mime, units, error} by the declared content types and the parts that must be there."""
    fail = lambda code: {"mime": None, "units": None, "error": code}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            if "[Content_Types].xml" not in names or z.getinfo("[Content_Types].xml").file_size > XML_BYTES:
                return fail("invalid_ooxml")
            declared = {x.attrib.get("ContentType", "") for x in ElementTree.fromstring(z.read("[Content_Types].xml"))}
    except (zipfile.BadZipFile, ElementTree.ParseError, OSError, KeyError, RuntimeError, ValueError):
        return fail("invalid_ooxml")
    for declares, (part, mime) in DOCUMENTS.items():
        if declares in declared and part in names:
            if part.startswith("word/"):
                return {"mime": mime, "units": 1, "error": None}
            slides = sum(n.startswith("ppt/slides/slide") and n.endswith(".xml") and n[16:-4].isdecimal() for n in names)
            return {"mime": mime, "units": slides, "error": None} if slides else fail("empty_document")
    return fail("archive_not_supported")


@F.arrow_udf(StructType([StructField("mime", StringType()), StructField("units", LongType()), StructField("error", StringType())]))
def office(content: pa.Array) -> pa.Array:
    kind = pa.struct([("mime", pa.string()), ("units", pa.int64()), ("error", pa.string())])
    return pa.array([office_identity(x or b"") for x in content.to_pylist()], kind)


def office_errors(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, mime, units, error): archive safety first, then the relationships, then what the document is."""
    safe = archive_errors(zip_entries(files, key, content), key)
    rows = files.select(key, content).join(safe, key)
    good = rows.where("error is null")
    bad = relationships(good, key, content).where("error is not null").groupBy(key).agg(F.min_by("error", F.struct("part", "ord")).alias("rel"))
    # what is not safe is not opened
    known = good.withColumn("o", office(F.col(content))).join(bad, key, "left")
    error = F.coalesce(F.when(F.col("o.error") == "invalid_ooxml", "invalid_ooxml"), F.col("rel"), F.col("o.error"))
    opened = known.select(key, F.when(error.isNull(), F.col("o.mime")).alias("mime"), F.when(error.isNull(), F.col("o.units")).alias("units"), error.alias("error"))
    return opened.unionByName(rows.where("error is not null").select(key, F.lit(None).cast("string").alias("mime"), F.lit(None).cast("long").alias("units"), "error"))


def office_images(rels: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Pictures that a document refers to: image relationships whose target is an entry, by the slide that owns them."""
    there = entries.select(key, F.col("name").alias("resolved"), "size")
    slide = F.regexp_extract("part", r"slide([0-9]+)\.xml\.rels$", 1)
    pictures = rels.where(F.col("type").endswith("/image") & F.col("error").isNull() & (F.col("part").startswith("word/") | F.col("part").startswith("ppt/slides/_rels/")))
    return pictures.join(there, [key, "resolved"]).select(key, F.when(slide == "", 1).otherwise(slide.cast("int")).alias("unit_index"), "rel_id", "resolved", "size")
