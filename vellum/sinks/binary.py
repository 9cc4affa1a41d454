"""XLSX, XLS, PPTX, PPT, DOC, DOCX and PDF: a document's dict in, bytes out."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

from ..functions import AVERAGE_WIDTH
from ..sources.markup import TRIM
from ..sources.ole import write_ole, write_summary

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
OFFICE = "http://schemas.openxmlformats.org"
NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def xml(text: str) -> str:
    return escape(NOT_XML.sub("", text or ""), {'"': "&quot;"})


def pack(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def relations(targets: list[tuple[str, str]]) -> str:
    """(kind, target) in order as rId1, rId2, ..."""
    rows = "".join(f'<Relationship Id="rId{k}" Type="{OFFICE}/{"package" if kind.startswith("metadata") else "officeDocument"}/2006/relationships/{kind}" Target="{t}"/>' for k, (kind, t) in enumerate(targets, 1))
    return f'{HEAD}<Relationships xmlns="{OFFICE}/package/2006/relationships">{rows}</Relationships>'


def content_types(parts: dict[str, str]) -> str:
    rows = "".join(f'<Override PartName="/{name}" ContentType="application/vnd.openxmlformats-{kind}+xml"/>' for name, kind in parts.items())
    return f'{HEAD}<Types xmlns="{OFFICE}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{rows}</Types>'


def core(doc: dict) -> str:
    author = (doc.get("metadata") or {}).get("author", "")
    return f'{HEAD}<cp:coreProperties xmlns:cp="{OFFICE}/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{xml(doc["title"])}</dc:title><dc:creator>{xml(author)}</dc:creator></cp:coreProperties>'


def _metadata(doc: dict) -> dict:
    got = doc.get("metadata") or {}
    return dict(got) if not isinstance(got, dict) else got


def _elements(section: dict) -> list[dict]:
    return section["elements"] or []


# Rows of sheets


def sheet_name(name: str) -> str:
    clean = re.sub(r"[\\/?*\[\]:]+", "_", name)
    return clean.encode()[:31].decode("utf-8", "ignore")


def sheets_of(doc: dict) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of each section with content: rows of tables, paragraphs as one cell."""
    out = []
    for s in doc["sections"]:
        rows = []
        for e in _elements(s):
            if e["type"] == "table":
                rows += [[c["text"] or "" for c in r["cells"]] for r in e["table"]["rows"]]
            elif e["type"] == "paragraph" and (e["text"] or "").strip(TRIM):
                rows.append([e["text"]])
        if rows:
            out.append((sheet_name(s["name"] or f"Sheet{len(out) + 1}"), rows))
    return out or [("Sheet1", [[""]])]


NUMERIC = re.compile(r"[ \t\n\r\v\f]*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?[ \t\n\r\v\f]*")


def letters(index: int) -> str:
    out, n = "", index + 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def render_xlsx(doc: dict) -> bytes:
    sheets, shared, parts = sheets_of(doc), {}, {}
    for k, (_, rows) in enumerate(sheets, 1):
        lines = []
        for i, row in enumerate(rows, 1):
            cells = []
            for j, v in enumerate(row):
                if NUMERIC.fullmatch(v):
                    cells.append(f'<c r="{letters(j)}{i}"><v>{xml(v.strip())}</v></c>')
                else:
                    cells.append(f'<c r="{letters(j)}{i}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>')
            lines.append(f'<row r="{i}">{"".join(cells)}</row>')
        parts[f"xl/worksheets/sheet{k}.xml"] = f'{HEAD}<worksheet xmlns="{OFFICE}/spreadsheetml/2006/main"><sheetData>{"".join(lines)}</sheetData></worksheet>'
    n = len(sheets)
    names = "".join(f'<sheet name="{xml(name)}" sheetId="{k}" r:id="rId{k}"/>' for k, (name, _) in enumerate(sheets, 1))
    sst = "".join(f'<si><t xml:space="preserve">{xml(s)}</t></si>' for s in shared)
    styles = '<fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="1"><xf/></cellXfs>'
    kinds = {"xl/workbook.xml": "officedocument.spreadsheetml.sheet.main", "xl/sharedStrings.xml": "officedocument.spreadsheetml.sharedStrings", "xl/styles.xml": "officedocument.spreadsheetml.styles", "docProps/core.xml": "package.core-properties"} | {p: "officedocument.spreadsheetml.worksheet" for p in parts}
    return pack(
        {
            "[Content_Types].xml": content_types(kinds),
            "_rels/.rels": relations([("officeDocument", "xl/workbook.xml"), ("metadata/core-properties", "docProps/core.xml")]),
            "xl/workbook.xml": f'{HEAD}<workbook xmlns="{OFFICE}/spreadsheetml/2006/main" xmlns:r="{OFFICE}/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": relations([("worksheet", f"worksheets/sheet{k}.xml") for k in range(1, n + 1)] + [("sharedStrings", "sharedStrings.xml"), ("styles", "styles.xml")]),
            "xl/sharedStrings.xml": f'{HEAD}<sst xmlns="{OFFICE}/spreadsheetml/2006/main" uniqueCount="{len(shared)}">{sst}</sst>',
            "xl/styles.xml": f'{HEAD}<styleSheet xmlns="{OFFICE}/spreadsheetml/2006/main">{styles}</styleSheet>',
            "docProps/core.xml": core(doc),
        }
        | parts
    )


RECORD_BYTES = 8224


def _record(kind: int, body: bytes = b"") -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def _strings(strings: list[str], total: int) -> bytes:
    """The shared table, broken into records where one is full; a string goes on with its width repeated."""
    out, part, kind = b"", struct.pack("<II", total, len(strings)), 0xFC
    for s in strings:
        raw = s.encode("utf-16-le", "replace")
        if len(raw) > 2 * XLS_CHARS:
            raise ValueError(f"a text of {len(raw) // 2} characters, and an XLS cell has {XLS_CHARS}")
        if len(part) + 3 > RECORD_BYTES:
            out, part, kind = out + _record(kind, part), b"", 0x3C
        part += struct.pack("<HB", len(raw) // 2, 1)
        while raw:
            room = (RECORD_BYTES - len(part)) // 2 * 2
            part, raw = part + raw[:room], raw[room:]
            if raw:
                out, part, kind = out + _record(kind, part), b"\x01", 0x3C
    return out + _record(kind, part)


#: What a BIFF8 sheet holds, and the characters of a text (fixed by the format).
XLS_ROWS, XLS_COLUMNS, XLS_CHARS = 65536, 256, 65535


def xls_sheets(doc: dict) -> list[tuple[str, list[list[str]]]]:
    """The document's sheets, the rows beyond what a sheet holds on further ones; what the format cannot hold is an error."""
    out = []
    for name, rows in sheets_of(doc):
        if (widest := max(map(len, rows), default=0)) > XLS_COLUMNS:
            raise ValueError(f"{name}: {widest} columns, and an XLS sheet has {XLS_COLUMNS}")
        out += [(name if not at else f"{name[:24]} ({at // XLS_ROWS + 1})", rows[at : at + XLS_ROWS]) for at in range(0, max(1, len(rows)), XLS_ROWS)]
    return out


def render_xls(doc: dict) -> bytes:
    """BIFF8: numbers as NUMBER, texts by the shared table."""
    sheets, shared, total = xls_sheets(doc), {}, 0
    bodies = []
    for _, rows in sheets:
        body = _record(0x809, struct.pack("<HHHHII", 0x600, 0x10, 0x0DBB, 0x07CC, 0, 6))
        body += _record(0x200, struct.pack("<IIHHH", 0, len(rows), 0, max(map(len, rows), default=0), 0))
        for i, row in enumerate(rows):
            for j, v in enumerate(row):
                if NUMERIC.fullmatch(v):
                    body += _record(0x203, struct.pack("<HHHd", i, j, 0, float(v)))
                else:
                    total += 1
                    body += _record(0xFD, struct.pack("<HHHI", i, j, 0, shared.setdefault(v, len(shared))))
        bodies.append(body + _record(0x0A))
    names = [n.encode("utf-16-le") for n, _ in sheets]
    start = _record(0x809, struct.pack("<HHHHII", 0x600, 5, 0x0DBB, 0x07CC, 0, 6)) + _record(0x42, struct.pack("<H", 1200))
    # one font and one cell format, which readers ask for
    start += _record(0x31, struct.pack("<HHHHHBBBBBB", 200, 0, 0x7FFF, 400, 0, 0, 0, 0, 0, 5, 0) + b"Arial") + _record(0xE0, struct.pack("<HHHBBBBIIH", 0, 0, 1, 0x20, 0, 0, 0, 0, 0, 0x20C0))
    rest = _strings(list(shared), total) + _record(0x0A)
    at = len(start) + sum(4 + 8 + len(n) for n in names) + len(rest)
    bound = b""
    for n, body in zip(names, bodies):
        bound += _record(0x85, struct.pack("<IBBBB", at, 0, 0, len(n) // 2, 1) + n)
        at += len(body)
    return write_ole({"Workbook": start + bound + rest + b"".join(bodies), "\x05SummaryInformation": write_summary(doc["title"], _metadata(doc).get("author", ""))})


# Slides

HEADING_HUNDREDTHS = (3200, 2600, 2200, 2000)


def _slide_run(r: dict, level: int | None) -> str:
    s = r["style"] or {}
    size = int(s["font_size"] * 100) if s.get("font_size") else HEADING_HUNDREDTHS[min(level, 4) - 1] if level else 1800
    marks = ' b="1"' * bool(level or s.get("bold")) + ' i="1"' * bool(s.get("italic")) + ' u="sng"' * bool(s.get("underline"))
    return f'<a:r><a:rPr lang="fr-FR" sz="{size}"{marks}/><a:t>{xml(r["text"])}</a:t></a:r>'


def _slide(section: dict) -> str:
    texts, tables = [], []
    for e in _elements(section):
        if e["type"] == "paragraph":
            level = (e["paragraph"]["style"] or {}).get("heading_level")
            texts.append(f'<a:p>{"<a:pPr lvl=" + chr(34) + "0" + chr(34) + "/>" if level else ""}{"".join(_slide_run(r, level) for r in e["paragraph"]["runs"])}</a:p>')
        elif e["type"] == "table" and e["table"]["rows"]:
            width = max(len(r["cells"]) for r in e["table"]["rows"])
            rows = "".join("<a:tr h=\"370840\">" + "".join(f'<a:tc><a:txBody><a:bodyPr/><a:p><a:r><a:rPr lang="fr-FR"/><a:t>{xml(c["text"])}</a:t></a:r></a:p></a:txBody><a:tcPr/></a:tc>' for c in r["cells"]) + "</a:tr>" for r in e["table"]["rows"])
            tables.append(f'<a:tbl><a:tblPr firstRow="1"/><a:tblGrid>{f"""<a:gridCol w="{8229600 // max(1, width)}"/>""" * width}</a:tblGrid>{rows}</a:tbl>')
    shapes = ""
    if texts:
        shapes += f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="Text"/><p:cNvSpPr txBox="1"/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="457200" y="274638"/><a:ext cx="8229600" cy="5851525"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr><p:txBody><a:bodyPr wrap="square"/><a:lstStyle/>{"".join(texts)}</p:txBody></p:sp>'
    for k, t in enumerate(tables, 3):
        shapes += f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="{k}" name="Table {k - 2}"/><p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr><p:xfrm><a:off x="457200" y="1600200"/><a:ext cx="8229600" cy="4525963"/></p:xfrm><a:graphic><a:graphicData uri="{OFFICE}/drawingml/2006/table">{t}</a:graphicData></a:graphic></p:graphicFrame>'
    return f'{HEAD}<p:sld {NS}><p:cSld><p:spTree>{GROUP}{shapes}</p:spTree></p:cSld></p:sld>'


NS = f'xmlns:a="{OFFICE}/drawingml/2006/main" xmlns:r="{OFFICE}/officeDocument/2006/relationships" xmlns:p="{OFFICE}/presentationml/2006/main"'
GROUP = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'


def _theme() -> str:
    colours = "".join(f'<a:{k}><a:srgbClr val="{v}"/></a:{k}>' for k, v in (("dk1", "000000"), ("lt1", "FFFFFF"), ("dk2", "1F2937"), ("lt2", "F3F4F6"), ("accent1", "2563EB"), ("accent2", "059669"), ("accent3", "D97706"), ("accent4", "DC2626"), ("accent5", "7C3AED"), ("accent6", "0891B2"), ("hlink", "2563EB"), ("folHlink", "7C3AED")))
    font = '<a:latin typeface="Calibri"/><a:ea typeface=""/><a:cs typeface=""/>'
    solid, line, effect = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>', '<a:ln w="9525"><a:solidFill><a:schemeClr val="phClr"/></a:solidFill></a:ln>', "<a:effectStyle><a:effectLst/></a:effectStyle>"
    return f'{HEAD}<a:theme xmlns:a="{OFFICE}/drawingml/2006/main" name="Plain"><a:themeElements><a:clrScheme name="Plain">{colours}</a:clrScheme><a:fontScheme name="Plain"><a:majorFont>{font}</a:majorFont><a:minorFont>{font}</a:minorFont></a:fontScheme><a:fmtScheme name="Plain"><a:fillStyleLst>{solid * 3}</a:fillStyleLst><a:lnStyleLst>{line * 3}</a:lnStyleLst><a:effectStyleLst>{effect * 3}</a:effectStyleLst><a:bgFillStyleLst>{solid * 3}</a:bgFillStyleLst></a:fmtScheme></a:themeElements></a:theme>'


def render_pptx(doc: dict) -> bytes:
    slides = {f"ppt/slides/slide{k}.xml": _slide(s) for k, s in enumerate(doc["sections"] or [{"name": "", "elements": []}], 1)}
    n = len(slides)
    ids = "".join(f'<p:sldId id="{255 + k}" r:id="rId{k + 1}"/>' for k in range(1, n + 1))
    kinds = {"ppt/presentation.xml": "officedocument.presentationml.presentation.main", "ppt/slideMasters/slideMaster1.xml": "officedocument.presentationml.slideMaster", "ppt/slideLayouts/slideLayout1.xml": "officedocument.presentationml.slideLayout", "ppt/theme/theme1.xml": "officedocument.theme", "docProps/core.xml": "package.core-properties"} | {p: "officedocument.presentationml.slide" for p in slides}
    tree = f"<p:cSld><p:spTree>{GROUP}</p:spTree></p:cSld>"
    mapping = " ".join(f'{k}="{v}"' for k, v in (("bg1", "lt1"), ("tx1", "dk1"), ("bg2", "lt2"), ("tx2", "dk2"), *((f"accent{i}", f"accent{i}") for i in range(1, 7)), ("hlink", "hlink"), ("folHlink", "folHlink")))
    return pack(
        {
            "[Content_Types].xml": content_types(kinds),
            "_rels/.rels": relations([("officeDocument", "ppt/presentation.xml"), ("metadata/core-properties", "docProps/core.xml")]),
            "ppt/presentation.xml": f'{HEAD}<p:presentation {NS}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>',
            "ppt/_rels/presentation.xml.rels": relations([("slideMaster", "slideMasters/slideMaster1.xml")] + [("slide", f"slides/slide{k}.xml") for k in range(1, n + 1)] + [("theme", "theme/theme1.xml")]),
            "ppt/slideMasters/slideMaster1.xml": f'{HEAD}<p:sldMaster {NS}>{tree}<p:clrMap {mapping}/><p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst></p:sldMaster>',
            "ppt/slideMasters/_rels/slideMaster1.xml.rels": relations([("slideLayout", "../slideLayouts/slideLayout1.xml"), ("theme", "../theme/theme1.xml")]),
            "ppt/slideLayouts/slideLayout1.xml": f'{HEAD}<p:sldLayout {NS} type="blank">{tree}</p:sldLayout>',
            "ppt/slideLayouts/_rels/slideLayout1.xml.rels": relations([("slideMaster", "../slideMasters/slideMaster1.xml")]),
            "ppt/theme/theme1.xml": _theme(),
            "docProps/core.xml": core(doc),
        }
        | slides
        | {f"ppt/slides/_rels/slide{k}.xml.rels": relations([("slideLayout", "../slideLayouts/slideLayout1.xml")]) for k in range(1, n + 1)}
    )


def slide_lines(section: dict) -> list[str]:
    """Texts of a slide, rows of tables with bars between the cells; the name if there are none."""
    out = []
    for e in _elements(section):
        if e["type"] == "paragraph" and (e["text"] or "").strip(TRIM):
            out.append(e["text"].strip(TRIM))
        elif e["type"] == "table":
            out += [x for r in e["table"]["rows"] if (x := " | ".join(c["text"] or "" for c in r["cells"])).strip(TRIM)]
    return out or [section["name"] or ""]


def _atom(kind: int, body: bytes, version: int = 0) -> bytes:
    return struct.pack("<HHI", version, kind, len(body)) + body


def render_ppt(doc: dict) -> bytes:
    """Slides as lists of text atoms within a document container."""
    lists = b""
    for k, s in enumerate(doc["sections"]):
        atoms = _atom(1011, struct.pack("<IIIII", k + 1, 0, 0, 256 + k, 0))
        for i, t in enumerate(slide_lines(s)):
            atoms += _atom(3999, struct.pack("<I", 0 if i == 0 else 1)) + _atom(4000, t.replace("\n", "\r").encode("utf-16-le", "replace"))
        lists += atoms
    body = _atom(1001, struct.pack("<IIIIIIIHHBBBB", 5760, 4320, 4320, 5760, 5, 10, 0, 1, 0, 0, 0, 0, 1)) + _atom(4080, lists, 0x0F)
    stream = _atom(1000, body, 0x0F)
    edit = len(stream)
    stream += _atom(4085, struct.pack("<IIIIIIHH", 0, 0x03000000, 0, edit, 1, 1, 1, 0))
    user = _atom(4086, struct.pack("<IIIHHBBH", 20, 0xE391C05F, edit, 0, 0x03F4, 3, 0, 0) + struct.pack("<I", 8))
    return write_ole({"PowerPoint Document": stream, "Current User": user, "\x05SummaryInformation": write_summary(doc["title"], _metadata(doc).get("author", ""))})


# Text documents


def doc_text(doc: dict) -> str:
    parts = []
    for s in doc["sections"]:
        for e in _elements(s):
            if e["type"] == "paragraph":
                parts.append(e["text"] or "")
            elif e["type"] == "table":
                parts += ["\t".join(c["text"] or "" for c in r["cells"]) for r in e["table"]["rows"]]
    return "\r".join(parts) + ("\r" if parts else "")


TEXT_START = 1024


def render_doc(doc: dict) -> bytes:
    """Word 97 text of one 8-bit piece (Windows-1252: other characters become `?`)."""
    text = doc_text(doc).encode("cp1252", "replace")
    clx = b"\x02" + struct.pack("<I", 16) + struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, TEXT_START * 2 | 0x40000000, 0)
    fib = struct.pack("<HHHHHHHIBBHHII", 0xA5EC, 0xC1, 0, 0x040C, 0, 1 << 9, 0xBF, 0, 0, 0, 0, 0, TEXT_START, TEXT_START + len(text))
    fib = fib.ljust(32, b"\0") + struct.pack("<H", 14) + b"\0" * 28 + struct.pack("<H", 22)
    fib += struct.pack("<22I", TEXT_START + len(text), 0, 0, len(text), *[0] * 18) + struct.pack("<H", 93)
    pairs = [0] * 186
    pairs[132], pairs[133] = 0, len(clx)
    fib += struct.pack("<186I", *pairs) + struct.pack("<H", 0)
    return write_ole({"WordDocument": fib.ljust(TEXT_START, b"\0") + text, "1Table": clx, "\x05SummaryInformation": write_summary(doc["title"], _metadata(doc).get("author", ""))})


def _docx_run(r: dict) -> str:
    s = r["style"]
    props = ""
    if s:
        props = "<w:rPr>" + f'<w:rFonts w:ascii="{xml(s["font_family"])}" w:hAnsi="{xml(s["font_family"])}"/>' + "<w:b/>" * bool(s["bold"]) + "<w:i/>" * bool(s["italic"]) + f'<w:color w:val="{xml((s["color"] or "").lstrip("#"))}"/><w:sz w:val="{round(s["font_size"] * 2)}"/>' + '<w:u w:val="single"/>' * bool(s["underline"]) + "</w:rPr>"
    pieces = '</w:t><w:br/><w:t xml:space="preserve">'.join(xml(x) for x in (r["text"] or "").split("\n"))
    return f'<w:r>{props}<w:t xml:space="preserve">{pieces}</w:t></w:r>'


def _docx_paragraph(p: dict) -> str:
    s, props = p["style"], ""
    if s:
        level = s["heading_level"]
        jc = {"justify": "both"}.get(s["alignment"], s["alignment"] or "left")
        props = "<w:pPr>" + (f'<w:pStyle w:val="Heading{level}"/>' if level else "") + f'<w:spacing w:before="{round((s["space_before"] or 0) * 20)}" w:after="{round((s["space_after"] or 0) * 20)}" w:line="{round((s["line_spacing"] or 1) * 240)}"/><w:jc w:val="{jc}"/></w:pPr>'
    return f"<w:p>{props}{''.join(_docx_run(r) for r in p['runs'])}</w:p>"


def render_docx(doc: dict) -> bytes:
    body = ""
    for s in doc["sections"]:
        for e in _elements(s):
            if e["type"] == "paragraph":
                body += _docx_paragraph(e["paragraph"])
            elif e["type"] == "page_break":
                body += '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
            elif e["type"] == "table":
                rows = ""
                for r in e["table"]["rows"]:
                    cells = "".join("<w:tc><w:tcPr>" + (f'<w:gridSpan w:val="{c["colspan"]}"/>' if (c["colspan"] or 1) > 1 else "") + ('<w:vMerge w:val="restart"/>' if (c["rowspan"] or 1) > 1 else "") + f"</w:tcPr><w:p>{''.join(_docx_run(x) for x in c['runs'])}</w:p></w:tc>" for c in r["cells"])
                    rows += "<w:tr>" + "<w:trPr><w:tblHeader/></w:trPr>" * bool(r["is_header"]) + cells + "</w:tr>"
                body += f"<w:tbl><w:tblPr/>{rows}</w:tbl>"
    space = f'xmlns:w="{OFFICE}/wordprocessingml/2006/main"'
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 7))
    kinds = {"word/document.xml": "officedocument.wordprocessingml.document.main", "word/styles.xml": "officedocument.wordprocessingml.styles", "docProps/core.xml": "package.core-properties"}
    return pack(
        {
            "[Content_Types].xml": content_types(kinds),
            "_rels/.rels": relations([("officeDocument", "word/document.xml"), ("metadata/core-properties", "docProps/core.xml")]),
            "word/document.xml": f"{HEAD}<w:document {space}><w:body>{body}</w:body></w:document>",
            "word/_rels/document.xml.rels": relations([("styles", "styles.xml")]),
            "word/styles.xml": f"{HEAD}<w:styles {space}>{styles}</w:styles>",
            "docProps/core.xml": core(doc),
        }
    )


# PDF

PAGE, MARGIN = (595.28, 841.89), 40.0


def base_font(style: dict) -> str:
    family = (style.get("font_family") or "").lower()
    bold, italic = style.get("bold"), style.get("italic")
    if "times" in family or family == "serif":
        return "Times-" + ("BoldItalic" if bold and italic else "Bold" if bold else "Italic" if italic else "Roman")
    kind = "Courier" if "courier" in family or family == "monospace" else "Helvetica"
    return kind + ("-BoldOblique" if bold and italic else "-Bold" if bold else "-Oblique" if italic else "")


def text_width(text: str, font: str, size: float) -> float:
    return len(text) * AVERAGE_WIDTH.get(font, 550) * size / 1000


def wrap(text: str, font: str, size: float, width: float) -> list[str]:
    """Greedy lines by the font's average glyph; a word wider than the line stands alone."""
    out, line = [], ""
    for word in text.split(" "):
        longer = f"{line} {word}" if line else word
        if line and text_width(longer, font, size) > width:
            out.append(line)
            line = word
        else:
            line = longer
    return out + [line] if line or not out else out


def rgb(color: str | None) -> tuple[float, float, float]:
    h = (color or "#000000").lstrip("#")
    try:
        return tuple(int(h[k : k + 2], 16) / 255 for k in (0, 2, 4))
    except ValueError:
        return 0.0, 0.0, 0.0


class _Pages:
    """Pages drawn from the top down."""

    def __init__(self):
        self.contents: list[list[bytes]] = []
        self.fonts: dict[str, str] = {}
        self.images: dict[bytes, tuple[str, bytes]] = {}
        self.new_page()

    def new_page(self) -> None:
        self.contents.append([])
        self.y = PAGE[1] - MARGIN

    @property
    def width(self) -> float:
        return PAGE[0] - 2 * MARGIN

    def need(self, height: float) -> None:
        if self.y - height < MARGIN:
            self.new_page()

    def text(self, text: str, font: str, size: float, x: float, y: float, color) -> None:
        name = self.fonts.setdefault(font, f"F{len(self.fonts) + 1}")
        raw = re.sub(rb"([\\()])", rb"\\\1", text.encode("cp1252", "replace"))
        self.contents[-1].append(b"BT\n%.2f %.2f %.2f rg\n/%s %.1f Tf\n%.2f %.2f Td\n(%s) Tj\nET\n" % (*color, name.encode(), size, x, y, raw))

    def paragraph_run(self, text: str, style: dict, spacing: float) -> None:
        font, size = base_font(style), style["font_size"]
        for part in text.split("\n"):
            for line in wrap(part, font, size, self.width):
                self.need(size * spacing)
                self.y -= size * spacing
                if line:
                    self.text(line, font, size, MARGIN, self.y, rgb(style.get("color")))

    def box(self, x: float, y: float, w: float, h: float, fill, border, line: float) -> None:
        if fill:
            self.contents[-1].append(b"%.3f %.3f %.3f rg\n%.2f %.2f %.2f %.2f re\nf\n" % (*rgb(fill), x, y, w, h))
        if line > 0:
            self.contents[-1].append(b"%.2f w\n%.3f %.3f %.3f RG\n%.2f %.2f %.2f %.2f re\nS\n" % (line, *rgb(border), x, y, w, h))

    def image(self, image: dict) -> None:
        made = image_object(image.get("data"), image.get("mime_type"))
        if not made:
            return
        w, h = float(image.get("width") or 200), float(image.get("height") or 150)
        if w > self.width:
            w, h = self.width, h * self.width / w
        self.need(h)
        name, _ = self.images.setdefault(made, (f"I{len(self.images) + 1}", made))
        self.contents[-1].append(b"q\n%.2f 0 0 %.2f %.2f %.2f cm\n/%s Do\nQ\n" % (w, h, MARGIN, self.y - h, name.encode()))
        self.y -= h + 6


def image_object(data: bytes | None, mime: str | None) -> bytes | None:
    """An image XObject: JPEG as it is, a PNG of plain grey or RGB with its own row filters."""
    if not data:
        return None
    if mime == "image/jpeg":
        size = jpeg_size(data)
        return b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /%s /BitsPerComponent 8 /Filter /DCTDecode /Length %d >>\nstream\n%s\nendstream" % (size[0], size[1], b"DeviceGray" if size[2] == 1 else b"DeviceRGB", len(data), data) if size else None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        w, h, bits, kind, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
        if kind not in (0, 2) or interlaced:
            return None
        body, at = b"", 8
        while at < len(data):
            (n,) = struct.unpack(">I", data[at : at + 4])
            body += data[at + 8 : at + 8 + n] if data[at + 4 : at + 8] == b"IDAT" else b""
            at += 12 + n
        colors = 1 if kind == 0 else 3
        return b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /%s /BitsPerComponent %d /Filter /FlateDecode /DecodeParms << /Predictor 15 /Colors %d /BitsPerComponent %d /Columns %d >> /Length %d >>\nstream\n%s\nendstream" % (w, h, b"DeviceGray" if kind == 0 else b"DeviceRGB", bits, colors, bits, w, len(body), body)
    return None


def jpeg_size(data: bytes) -> tuple[int, int, int] | None:
    at = 2
    while at + 9 < len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h, data[at + 9]
        at += 2 + size
    return None


def _pdf_table(p: _Pages, table: dict, default: dict) -> None:
    rows = table["rows"]
    n = max((len(r["cells"]) for r in rows), default=0)
    if not n:
        return
    style, widths = table["style"] or {}, table["column_widths"] or [1.0] * n
    widths = [w / sum(widths) * p.width for w in widths]
    padding, line = style.get("cell_padding", 4.0), style.get("border_width", 0.5)
    size = default["font_size"]
    for r in rows:
        font = base_font(default | {"bold": default["bold"] or r["is_header"]})
        texts = [wrap(c["text"] or "", font, size, widths[min(k, len(widths) - 1)] - 2 * padding) for k, c in enumerate(r["cells"])]
        height = size * 1.15 * max((len(t) for t in texts), default=1) + 2 * padding
        p.need(height)
        x = MARGIN
        for k, w in enumerate(widths):
            p.box(x, p.y - height, w, height, style.get("header_bg", "#f3f4f6") if r["is_header"] else None, style.get("border_color", "#000000"), line)
            for i, t in enumerate(texts[k] if k < len(texts) else []):
                p.text(t, font, size, x + padding, p.y - padding - size - i * size * 1.15, rgb(default["color"]))
            x += w
        p.y -= height
    p.y -= 6


def render_pdf(doc: dict) -> bytes:
    """A page or more for each section; runs of a paragraph begin lines of their own."""
    p, default = _Pages(), doc["default_style"] or {"font_family": "Helvetica", "font_size": 12.0, "color": "#000000", "bold": False, "italic": False, "underline": False}
    for k, s in enumerate(doc["sections"]):
        if k:
            p.new_page()
        for e in _elements(s):
            if e["type"] == "paragraph":
                st = e["paragraph"]["style"] or {"space_before": 0.0, "space_after": 6.0, "line_spacing": 1.15, "heading_level": None}
                level = st["heading_level"]
                p.y -= max(st["space_before"] or 0, 12.0 if level else 0)
                own = default | {"font_size": (24.0, 20.0, 16.0, 14.0)[min(level, 4) - 1], "bold": True} if level else default
                for r in e["paragraph"]["runs"]:
                    p.paragraph_run(r["text"] or "", r["style"] or own, st["line_spacing"] or 1.15)
                p.y -= max(st["space_after"] or 0, 8.0 if level else 0)
            elif e["type"] == "table":
                _pdf_table(p, e["table"], default)
            elif e["type"] == "image":
                p.image(e["image"])
            elif e["type"] == "page_break":
                p.new_page()
    objects: list[bytes] = [b"", b""]  # catalogue and page list come first

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    fonts = {name: add(b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % font.encode()) for font, name in p.fonts.items()}
    images = {name: add(body) for name, body in p.images.values()}
    refs = lambda d: b" ".join(b"/%s %d 0 R" % (k.encode(), v) for k, v in d.items())
    resources = add(b"<< /Font << " + refs(fonts) + b" >> /XObject << " + refs(images) + b" >> >>")
    kids = []
    for content in p.contents:
        packed = zlib.compress(b"".join(content))
        stream = add(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed))
        kids.append(add(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.2f %.2f] /Resources %d 0 R /Contents %d 0 R >>" % (*PAGE, resources, stream)))
    meta = _metadata(doc)
    quote = lambda s: b"(" + re.sub(rb"([\\()])", rb"\\\1", (b"\xfe\xff" + s.encode("utf-16-be")) if not s.isascii() else s.encode()) + b")"
    info = add(b"<< /Title " + quote(doc["title"] or "") + b"".join(b" /%s %s" % (k.title().encode(), quote(meta[k])) for k in ("author", "creator") if meta.get(k)) + b" >>")
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    out, places = b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n", []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    table = b"".join(b"%010d 00000 n \n" % x for x in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, info, len(out))
