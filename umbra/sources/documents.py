"""Documents to text: format sniffing and extractors for HTML, mail, RTF and zipped XML."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of an extracted attachment that are kept; a longer one says so in ``truncated``.
MAX_CHARS = 200_000
ZIP_ENTRIES, ZIP_ENTRY_BYTES, ZIP_TOTAL_BYTES = 2048, 16 << 20, 64 << 20


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder: ``path, content, length``; dot files are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return rows.where(~F.rlike("path", F.lit(r"/(\.[^/]+|node_modules)(/|$)"))).select("path", "content", "length")


def sniffed(content: Column) -> Column:
    """Format from the content: pdf, zip, rtf, png, jpeg, gif, tiff, bmp, webp, html, eml, text, binary, empty."""
    hex_head = F.hex(F.substring(content, 1, 16))
    text = F.when(F.is_valid_utf8(F.substring(content, 1, 1024).cast("string")), F.substring(content, 1, 1024).cast("string"))
    control = F.char_length(F.regexp_replace(text, r"[^\x00-\x08\x0E-\x1F]", ""))
    return (
        F.when(F.octet_length(content) == 0, "empty")
        .when(F.contains(F.hex(F.substring(content, 1, 1024)), F.lit("255044462D")), "pdf")
        .when(F.startswith(hex_head, F.lit("504B0304")), "zip")
        .when(F.startswith(hex_head, F.lit("7B5C727466")), "rtf")
        .when(F.startswith(hex_head, F.lit("89504E47")), "png")
        .when(F.startswith(hex_head, F.lit("FFD8FF")), "jpeg")
        .when(F.startswith(hex_head, F.lit("47494638")), "gif")
        .when(F.startswith(hex_head, F.lit("49492A00")) | F.startswith(hex_head, F.lit("4D4D002A")), "tiff")
        .when(F.startswith(hex_head, F.lit("424D")) & text.isNull(), "bmp")
        .when(F.startswith(hex_head, F.lit("52494646")) & F.contains(hex_head, F.lit("57454250")), "webp")
        .when(F.rlike(text, F.lit(r"(?is)^\s*(?:<!doctype html|<html|<body|<head|<!--)")), "html")
        .when(F.rlike(text, F.lit(r"(?i)^(?:from|to|subject|date|received|return-path|mime-version|message-id):[^\n]*\n(?:[A-Za-z-]+:|[ \t]|\r?\n)")), "eml")
        .when(text.isNotNull() & (control <= F.char_length(text) / 100), "text")
        .otherwise("binary")
    )


_DROPPED = {"script", "style", "template", "noscript"}
_ONE = {"br", "tr", "li", "dt", "dd", "div", "option"}
_TWO = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "section", "article", "header", "footer", "nav", "aside", "blockquote", "pre", "form"}
_SHOWN = ("href", "alt", "title", "content")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.dropped, self.head, self.title = 0, False, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.dropped += tag in _DROPPED
        self.head, self.title = self.head or tag == "head", tag == "title"
        self._line(tag)
        for name, value in attrs:
            if name in _SHOWN and value and not self.dropped:
                self.out.append(f" {value} ")

    def handle_endtag(self, tag: str) -> None:
        self.dropped = max(0, self.dropped - (tag in _DROPPED))
        if tag == "head":
            self.head = False
        self.title = False
        if tag in ("td", "th"):
            self.out.append("\t")
        self._line(tag)

    def _line(self, tag: str) -> None:
        if tag in _TWO:
            self.out.append("\n\n")
        elif tag in _ONE:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.dropped and (not self.head or self.title):
            self.out.append(re.sub(r"[ \t\r\n\f]+", " ", data))


def from_html(page: str | None) -> str:
    """Visible text and attribute texts; blocks on lines of their own, at most one blank line."""
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    text = re.sub(r" *\n *", "\n", re.sub(r"[ ]{2,}", " ", "".join(parser.out)))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def html_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([from_html(x) for x in batch.column(html).to_pylist()], pa.string())], names=[key, "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, text string")


def from_plain(content: bytes) -> str:
    """UTF-8 or UTF-16 by mark or by zero bytes, else windows-1252; line ends as \\n."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text = content.decode("utf-16", "replace")
    elif content[:4096].count(0) > 0.3 * len(content[:4096]):
        text = content.decode("utf-16-le" if content[1:4096:2].count(0) > content[0:4096:2].count(0) else "utf-16-be", "replace")
    else:
        try:
            text = content.decode("utf-8-sig")
        except UnicodeDecodeError:
            text = content.decode("cp1252", "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n").rstrip("\0")


def from_mail(content: bytes) -> str:
    message = email.message_from_bytes(content, policy=email.policy.default)
    lines = [f"{h}: {message[h]}" for h in ("From", "To", "Cc", "Subject", "Date") if message[h]]
    body = message.get_body(preferencelist=("plain", "html"))
    if body is not None:
        text = body.get_content()
        lines += ["", from_html(text) if body.get_content_subtype() == "html" else text]
    return "\n".join(lines).strip()


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?[0-9]{1,6}) ?\??|\\([a-z]{1,32})(-?[0-9]{1,10})? ?|\\([^a-z])|([{}])|([^\\{}]+)", re.S)
_RTF_DROPPED = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "object", "themedata", "generator"}


def from_rtf(content: bytes) -> str:
    out: list[str] = []
    stack, dropped = [], False
    for byte, point, word, _, symbol, brace, plain in _RTF.findall(content.decode("latin-1")):
        if brace == "{":
            stack.append(dropped)
            if len(stack) > 256:
                raise ValueError("nested too deep")
        elif brace == "}":
            dropped = stack.pop() if stack else False
        elif word in _RTF_DROPPED or symbol == "*":
            dropped = True
        elif dropped:
            continue
        elif byte:
            out.append(bytes([int(byte, 16)]).decode("cp1252", "replace"))
        elif point:
            out.append(chr(int(point) % 65536))
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif symbol in ("\\", "{", "}"):
            out.append(symbol)
        elif plain:
            out.append(plain.replace("\r", "").replace("\n", ""))
    return "".join(out).strip()


# parts with text and the tags that end a line, by kind of package
_PARTS = [(re.compile(r"word/document\.xml$"), "w:p"), (re.compile(r"ppt/slides/slide[0-9]+\.xml$"), "a:p"), (re.compile(r"xl/sharedStrings\.xml$"), "si"), (re.compile(r"content\.xml$"), "text:p")]


def from_office(content: bytes) -> str:
    """Texts of the main parts of zipped XML documents; sizes are bounded and document types refused."""
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        entries = package.infolist()
        if len(entries) > ZIP_ENTRIES or sum(e.file_size for e in entries) > ZIP_TOTAL_BYTES:
            raise ValueError("package too large")
        for pattern, end in _PARTS:
            for entry in sorted((e for e in entries if pattern.search(e.filename)), key=lambda e: (len(e.filename), e.filename)):
                if entry.file_size > ZIP_ENTRY_BYTES:
                    raise ValueError("part too large")
                xml = package.read(entry).decode("utf-8", "replace")
                if "<!DOCTYPE" in xml:
                    raise ValueError("document types are refused")
                xml = re.sub(rf"</{end}>", "\n", re.sub(r"<(?:w:tab|text:tab)[^>]*>", "\t", re.sub(r"<(?:w:br|a:br|text:line-break)[^>]*>", "\n", xml)))
                import html

                out.append(html.unescape(re.sub(r"<[^>]*>", "", xml)))
    return "".join(out).strip()


EXTRACTORS: dict[str, Callable[[bytes], str]] = {"zip": from_office, "eml": from_mail, "html": lambda b: from_html(from_plain(b)), "rtf": from_rtf, "text": from_plain}
RESULT = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("truncated", T.BooleanType())])


def extract(data: bytes | None, kind: str | None, most: int | None = MAX_CHARS) -> dict[str, object]:
    """``ok, text, reason, truncated`` of one payload; ``most``: characters kept (None: all)."""
    if data is None or kind not in EXTRACTORS:
        return {"ok": False, "text": None, "reason": f"no extractor for {kind}", "truncated": False}
    try:
        text = EXTRACTORS[kind](bytes(data))
    except (ValueError, zipfile.BadZipFile, KeyError, LookupError) as error:
        return {"ok": False, "text": None, "reason": str(error)[:200], "truncated": False}
    return {"ok": True, "text": text[:most], "reason": None, "truncated": most is not None and len(text) > most}


def extracted(df: DataFrame, content: str = "content", most: int | None = MAX_CHARS) -> DataFrame:
    """Adds ``format`` and ``extracted`` (ok, text, reason, truncated) to rows with bytes."""

    def run(data: pa.Array, kinds: pa.Array) -> pa.Array:
        rows = [extract(d.as_py(), k.as_py(), most) for d, k in zip(data, kinds)]
        return pa.array(rows, pa.struct([("ok", pa.bool_()), ("text", pa.string()), ("reason", pa.string()), ("truncated", pa.bool_())]))

    return df.withColumn("format", sniffed(F.col(content))).withColumn("extracted", F.arrow_udf(run, RESULT)(F.col(content), F.col("format")))


_OBJECT = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_COUNT = re.compile(rb"/Count\s+([0-9]{1,7})")
#: Bytes of a document's head and tail that the probe reads.
PROBED_BYTES = 2 << 20


def pdf_probe(content: bytes | None) -> dict[str, object] | None:
    """``version, pages, encrypted, has_text`` of a PDF, from its head and tail; none for other content."""
    if content is None or b"%PDF-" not in content[:1024]:
        return None
    part = content if len(content) <= 2 * PROBED_BYTES else content[:PROBED_BYTES] + content[-PROBED_BYTES:]
    version = re.search(rb"%PDF-([0-9]\.[0-9])", content[:1024])
    roots = [n for n in map(int, _COUNT.findall(part)) if n > 0]
    pages = min(roots) if roots and b"/Pages" in part else len(_OBJECT.findall(part)) or None
    return {"version": version[1].decode() if version else None, "pages": pages, "encrypted": b"/Encrypt" in part, "has_text": b"/Font" in part or b"BT" in part and b"Tj" in part}


# fixed values: media types of the formats
MEDIA_TYPES = {
    "pdf": "application/pdf", "rtf": "application/rtf", "html": "text/html", "eml": "message/rfc822", "text": "text/plain", "png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif",
    "tiff": "image/tiff", "webp": "image/webp", "bmp": "image/bmp", "zip": "application/zip",
}


def media_type(declared: Column) -> Column:
    """A media type without parameters in lower case; null if it is none or longer than 128 characters."""
    bare = F.lower(F.trim(F.substring_index(declared, ";", 1)))
    return F.when(F.rlike(bare, F.lit(r"^[a-z0-9][a-z0-9!#$&^_.+-]{0,126}/[a-z0-9][a-z0-9!#$&^_.+-]{0,126}$")) & (F.char_length(bare) <= 128), bare)
