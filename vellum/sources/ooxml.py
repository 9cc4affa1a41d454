"""DOCX, XLSX and PPTX: zip archives of XML, read with the standard library."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile

from .. import model as m
from .markup import TRIM, stem

MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml", "webp": "image/webp", "emf": "image/x-emf", "wmf": "image/x-wmf"}
EMU_PER_PIXEL = 9525


class Package:
    """An archive whose tags and attributes are known by their local names."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def bytes(self, name: str) -> bytes | None:
        return self.zip.read(name) if name in self.names else None

    def size(self, name: str) -> int:
        return self.zip.getinfo(name).file_size if name in self.names else 0

    def xml(self, name: str) -> ET.Element | None:
        data = self.bytes(name)
        if data is None:
            return None
        try:
            root = ET.fromstring(data)
        except ET.ParseError:
            return None
        for x in root.iter():
            x.tag = x.tag.rpartition("}")[2]
            for k in [k for k in x.attrib if "}" in k]:
                x.attrib[("r:" if "relationships" in k else "") + k.rpartition("}")[2]] = x.attrib.pop(k)
        return root

    def relations(self, part: str) -> dict[str, str]:
        """Relationship id to the path of its target."""
        folder, file = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{file}.rels" if folder else f"_rels/{file}.rels")
        return {} if root is None else {r.get("Id", ""): resolve(part, r.get("Target", "")) for r in root.iter("Relationship")}

    def properties(self) -> tuple[str, dict]:
        root = self.xml("docProps/core.xml")
        if root is None:
            return "", {}
        first = lambda tag: next((x.text or "" for x in root.iter(tag)), "")
        return first("title").strip(TRIM), {"author": first("creator").strip(TRIM)} if first("creator").strip(TRIM) else {}


def resolve(part: str, target: str) -> str:
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(part), target))


def picture(pack: Package, path: str, width: int = 0, height: int = 0, alt: str = "") -> dict | None:
    data = pack.bytes(path)
    if data is None:
        return None
    return m.image(posixpath.basename(path), width, height, alt, data, MIME.get(path.rpartition(".")[2].lower(), "application/octet-stream"))


# DOCX

# Style ids and parts of style names that make a heading, in the order in which they are looked for.
HEADING_STYLES = {
    "heading1": 1,
    "heading2": 2,
    "heading3": 3,
    "heading4": 4,
    "heading5": 4,
    "heading6": 4,
    "titre": 1,
    "titre1": 1,
    "titre2": 2,
    "titre3": 3,
    "titre4": 4,
    "title": 1,
}


def _on(props: ET.Element, tag: str) -> bool:
    x = props.find(tag)
    return x is not None and x.get("val", "1") not in ("0", "false", "none")


class _Docx:
    def __init__(self, pack: Package):
        self.pack, self.rels = pack, pack.relations("word/document.xml")
        styles = pack.xml("word/styles.xml")
        self.styles = {}
        for s in styles.iter("style") if styles is not None else ():
            name = s.find("name")
            if name is not None:
                self.styles[s.get("styleId", "").lower()] = name.get("val", "").lower()

    def level(self, p: ET.Element) -> int | None:
        style, outline = p.find("pPr/pStyle"), p.find("pPr/outlineLvl")
        if style is None:
            return None
        key = style.get("val", "").lower()
        if key in HEADING_STYLES:
            return HEADING_STYLES[key]
        for part, level in HEADING_STYLES.items():
            if part in self.styles.get(key, ""):
                return level
        return min(int(outline.get("val", "0")) + 1, 4) if outline is not None else None

    def para_style(self, p: ET.Element) -> dict | None:
        props = p.find("pPr")
        if props is None:
            return None
        given, jc, gap = {}, props.find("jc"), props.find("spacing")
        if jc is not None:
            given["alignment"] = {"center": "center", "right": "right", "end": "right", "both": "justify", "distribute": "justify"}.get(jc.get("val", ""), "left")
        if gap is not None:
            for key, attr, unit in (("space_before", "before", 20.0), ("space_after", "after", 20.0), ("line_spacing", "line", 240.0)):
                if re.fullmatch(r"-?\d+", gap.get(attr, "")):
                    given[key] = int(gap.get(attr)) / unit
        return m.para_style(**given) if given else None

    def run_style(self, r: ET.Element) -> dict | None:
        props = r.find("rPr")
        if props is None:
            return None
        given = {k: True for k, tag in (("bold", "b"), ("italic", "i"), ("underline", "u")) if _on(props, tag)}
        color, size, font = props.find("color"), props.find("sz"), props.find("rFonts")
        if color is not None and color.get("val", "auto") != "auto":
            given["color"] = f"#{color.get('val')}"
        if size is not None and size.get("val", "").isdigit():
            given["font_size"] = int(size.get("val")) / 2
        if font is not None and (font.get("ascii") or font.get("hAnsi")):
            given["font_family"] = font.get("ascii") or font.get("hAnsi")
        return m.text_style(**given) if given else None

    def runs(self, p: ET.Element, out: list[dict]) -> list[dict]:
        """The paragraph's runs; its breaks and drawings go to out, before it."""
        made = []
        for r in p.iter("r"):
            drawing = r.find("drawing")
            if drawing is not None:
                out += self.drawing(drawing)
                continue
            kinds = [b.get("type") for b in r.findall("br")]
            out += [m.page_break() for k in kinds if k in ("page", "column")]
            out += [m.page_break()] if r.find("lastRenderedPageBreak") is not None else []
            text = "".join(t.text or "" for t in r.findall("t"))
            if text:
                made.append(m.run(text, self.run_style(r)))
            elif any(k not in ("page", "column") for k in kinds):
                made.append(m.run("\n"))
        return made

    def drawing(self, x: ET.Element) -> list[dict]:
        blip, extent, props = next(x.iter("blip"), None), next(x.iter("extent"), None), next(x.iter("docPr"), None)
        if blip is None:
            return []
        pixels = lambda k: round(int(extent.get(k, "0")) / EMU_PER_PIXEL) if extent is not None else 0
        alt = (props.get("descr") or props.get("name") or "") if props is not None else ""
        made = picture(self.pack, self.rels.get(blip.get("r:embed", ""), ""), pixels("cx"), pixels("cy"), alt)
        return [made] if made else []

    def table(self, t: ET.Element) -> list[dict]:
        rows = []
        for tr in t.findall("tr"):
            cells = []
            for tc in tr.findall("tc"):
                span, merge = tc.find("tcPr/gridSpan"), tc.find("tcPr/vMerge")
                texts = ["".join(x.text or "" for x in p.iter("t")) for p in tc.findall("p")]
                wide = int(span.get("val", "1")) if span is not None and span.get("val", "").isdigit() else 1
                cells.append(m.cell(" ".join(x for x in texts if x), max(1, wide), 2 if merge is not None and merge.get("val") == "restart" else 1))
            rows.append((not rows or tr.find("trPr/tblHeader") is not None, cells))
        borders, given = t.find("tblPr/tblBorders/top"), {}
        if borders is not None:
            given["border_style"] = {"nil": "none", "none": "none", "dashed": "dashed", "dotted": "dotted"}.get(borders.get("val", ""), "solid")
            if borders.get("sz", "").isdigit():
                given["border_width"] = int(borders.get("sz")) / 8
            if borders.get("color", "auto") != "auto":
                given["border_color"] = f"#{borders.get('color')}"
        return [m.table(rows, m.table_style(**given) if given else None)] if rows else []

    def blocks(self, body: ET.Element) -> list[dict]:
        out: list[dict] = []
        for x in body:
            if x.tag == "p":
                level = self.level(x)
                if level is not None:
                    text = "".join(t.text or "" for t in x.iter("t")).strip(TRIM)
                    out += [m.heading(text, level)] if text else []
                else:
                    runs = self.runs(x, out)
                    out += [m.paragraph(runs, self.para_style(x))] if runs else []
            elif x.tag == "tbl":
                out += self.table(x)
            elif x.tag in ("sdt", "sdtContent"):
                out += self.blocks(x)
        return out


def parse_docx(data: bytes, name: str = "", **_) -> dict:
    pack = Package(data)
    root = pack.xml("word/document.xml")
    if root is None:
        raise ValueError("word/document.xml is missing or unreadable")
    title, meta = pack.properties()
    body = root.find("body")
    return m.document("docx", title, [m.section("main", _Docx(pack).blocks(body) if body is not None else [])], meta)


# XLSX

#: The usual limit for those who want one (fixed).
SHEET_LIMIT = 50 * 1024 * 1024


def column_index(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Za-z]*", ref)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell_text(c: ET.Element, shared: list[str]) -> str:
    kind, value = c.get("t", ""), c.findtext("v") or ""
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter("t"))
    if kind == "s":
        return shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    return value


def _sheet_rows(root: ET.Element, shared: list[str]) -> list[list[str]]:
    """Dense rows, each as wide as the widest so far."""
    rows, width = [], 0
    for row in root.iter("row"):
        found, at = {}, -1
        for c in row.findall("c"):
            at = column_index(c.get("r", "")) if c.get("r") else at + 1
            found[at] = _cell_text(c, shared)
        if found:
            width = max(width, max(found) + 1)
            rows.append([found.get(k, "") for k in range(width)])
    return rows


def parse_xlsx(data: bytes, name: str = "", sheet_limit: int | None = None, **_) -> dict:
    """A section for each sheet with rows.

    With a limit, sheets of more bytes (unpacked) are left out unread, and the metadata `sheets_left_out` names them.
    """
    pack = Package(data)
    root = pack.xml("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter("t")) for si in root.iter("si")] if root is not None else []
    book, rels = pack.xml("xl/workbook.xml"), pack.relations("xl/workbook.xml")
    sheets = [(s.get("name", ""), rels.get(s.get("r:id", ""), "")) for s in book.iter("sheet")] if book is not None else []
    if not sheets:
        sheets = [(f"Sheet{k}", f"xl/worksheets/sheet{k}.xml") for k in range(1, 11) if f"xl/worksheets/sheet{k}.xml" in pack.names]
    made, left_out = [], [label for label, path in sheets if sheet_limit is not None and pack.size(path) > sheet_limit]
    for label, path in sheets:
        root = pack.xml(path) if label not in left_out and pack.size(path) > 0 else None
        rows = _sheet_rows(root, shared) if root is not None else []
        if rows:
            made.append(m.section(label, [m.table([(k == 0, r) for k, r in enumerate(rows)])]))
    pictures = [p for x in sorted(pack.names) if x.startswith("xl/media/") and (p := picture(pack, x))]
    if pictures:
        made = made or [m.section(sheets[0][0] if sheets else "Sheet1")]
        made[0]["elements"] += pictures
    title, meta = pack.properties()
    return m.document("xlsx", title or stem(name), made, meta | ({"sheets_left_out": ", ".join(left_out)} if left_out else {}))


# PPTX

LAST_SLIDE = 200


def _slide_paragraph(p: ET.Element) -> list[dict]:
    runs = []
    for r in p.findall("r"):
        text, props = r.findtext("t") or "", r.find("rPr")
        if not text:
            continue
        given = {}
        if props is not None:
            given = {k: True for k, a in (("bold", "b"), ("italic", "i")) if props.get(a) in ("1", "true")}
            if props.get("u", "none") != "none":
                given["underline"] = True
            if props.get("sz", "").isdigit():
                given["font_size"] = int(props.get("sz")) / 100
            color, font = props.find("solidFill/srgbClr"), props.find("latin")
            if color is not None:
                given["color"] = f"#{color.get('val', '000000')}"
            if font is not None and font.get("typeface"):
                given["font_family"] = font.get("typeface")
        runs.append(m.run(text, m.text_style(**given) if given else None))
    runs += [m.run(t.text) for t in p.findall("fld/t") if t.text]
    if not runs:
        return []
    props, level = p.find("pPr"), None
    if props is not None and props.get("lvl") == "0" and props.find("defRPr") is not None and props.find("defRPr").get("sz", "").isdigit():
        size = int(props.find("defRPr").get("sz"))
        level = 1 if size >= 2400 else 2 if size >= 2000 else None
    return [m.paragraph(runs, m.para_style(heading_level=level) if level else None)]


def _slide(pack: Package, path: str, number: int) -> dict | None:
    root = pack.xml(path)
    if root is None:
        return None
    out = [x for sp in root.iter("sp") for body in list(sp.iter("txBody"))[:1] for p in body.findall("p") for x in _slide_paragraph(p)]
    for t in root.iter("tbl"):
        rows = [(k == 0, [m.cell(" ".join(x for p in tc.iter("p") if (x := "".join(y.text or "" for y in p.iter("t")))), max(1, int(tc.get("gridSpan", "1")))) for tc in tr.findall("tc")]) for k, tr in enumerate(t.findall("tr"))]
        out += [m.table(rows)] if rows else []
    rels = pack.relations(path)
    for pic in root.iter("pic"):
        blip, props, size = next(pic.iter("blip"), None), next(pic.iter("cNvPr"), None), next(pic.iter("ext"), None)
        if blip is not None:
            pixels = lambda k: round(int(size.get(k, "0")) / EMU_PER_PIXEL) if size is not None else 0  # noqa: E731, B023
            made = picture(pack, rels.get(blip.get("r:embed", ""), ""), pixels("cx"), pixels("cy"), (props.get("descr") or props.get("name") or "") if props is not None else "")
            out += [made] if made else []
    return m.section(f"slide-{number}", out) if out else None


def parse_pptx(data: bytes, name: str = "", **_) -> dict:
    """Slides in the presentation's order, else by number until one is missing; empty slides are left out."""
    pack = Package(data)
    show, rels = pack.xml("ppt/presentation.xml"), pack.relations("ppt/presentation.xml")
    order = [rels[x.get("r:id", "")] for x in show.iter("sldId") if x.get("r:id", "") in rels] if show is not None else []
    if not order:
        for k in range(1, LAST_SLIDE + 1):
            if f"ppt/slides/slide{k}.xml" not in pack.names:
                break
            order.append(f"ppt/slides/slide{k}.xml")
    made = [s for k, path in enumerate(order, 1) if (s := _slide(pack, path, k))]
    title, meta = pack.properties()
    return m.document("pptx", title or stem(name), made, meta)
