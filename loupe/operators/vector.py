"""SVG: its elements as rows, and what is concluded from them."""

from __future__ import annotations

import xml.parsers.expat
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.operators.detect_text import HTML_COMMENT, PROTECTED_MARKERS
from loupe.operators.structure import MAX_DEPTH, MAX_EVENTS, _rule_hits, parsed
from loupe.plans.fixtures import bound
from loupe.registry import query

# Prefixes of editors' own attributes, metadata blocks, and shapes that have a place.
EDITORS = ("inkscape", "sodipodi", "adobe", "serif", "sketch")
METADATA = ("metadata", "rdf", "RDF", "xmpmeta")
SHAPES = ("path", "rect", "circle", "ellipse", "polygon", "polyline", "line")
PLACES = ("x", "y", "cx", "cy", "x1", "x2", "y1", "y2")


def _elements(text: str | None) -> Iterator[tuple]:
    """(kind, element number, depth, tag, name, value, inside a metadata block)."""
    rows: list[tuple] = []
    stack: list[str] = []
    count = 0

    def put(*row) -> None:
        if len(rows) >= MAX_EVENTS:
            raise OverflowError("events")
        rows.append(row)

    def start(name, attrs):
        nonlocal count
        tag = name.split(":")[-1]
        inside = any(s in METADATA for s in stack)
        stack.append(tag)
        if len(stack) > MAX_DEPTH:
            raise OverflowError("depth")
        put("element", count, len(stack), tag, None, None, inside)
        for key, value in attrs.items():
            put("attribute", count, len(stack), tag, key, value, inside)
        count += 1

    def refuse(*_):
        raise ValueError("document type")

    p = xml.parsers.expat.ParserCreate()
    p.StartDoctypeDeclHandler, p.StartElementHandler = refuse, start
    p.EndElementHandler = lambda _: stack.pop()
    p.CommentHandler = lambda data: put("comment", count, len(stack), None, None, data, False)
    p.Parse(text or "", True)
    return iter(rows)


def svg_elements(images: DataFrame) -> DataFrame:
    return parsed(images, "text", _elements, "kind string, element int, depth int, tag string, name string, value string, inside_metadata boolean")


def _protected(value: Column) -> Column:
    out = F.lit(False)
    for marker in PROTECTED_MARKERS:
        out = out | F.lower(value).contains(marker)
    return out


def svg_findings(rows: DataFrame) -> DataFrame:
    """All findings of SVG files: artifact_path, category, detail, removable."""
    rows = rows.where("error is null")
    elements, attrs, notes = rows.where("kind = 'element'"), rows.where("kind = 'attribute'"), rows.where("kind = 'comment'")

    def found(df: DataFrame, category: str, detail, removable) -> DataFrame:
        return df.select("artifact_path", F.lit(category).alias("category"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"), (F.lit(removable) if isinstance(removable, bool) else removable).alias("removable"))

    blocks = found(elements.where(F.col("tag").isin(*METADATA) & ~F.col("inside_metadata")), "generator_metadata", "metadata block", True)
    own = attrs.where(F.lower("name").rlike("|".join(EDITORS)) & ~F.col("name").startswith("xmlns")).groupBy("artifact_path", "element").agg(F.max(_protected(F.concat_ws(" ", "name", "value"))).alias("p"))
    editors = found(own, "generator_metadata", "editor attributes", ~F.col("p"))
    style = F.lower(F.replace("value", F.lit(" "), F.lit("")))
    hides = (
        ((F.col("name") == "display") & (F.lower("value") == "none"))
        | ((F.col("name") == "visibility") & (F.lower("value") == "hidden"))
        | ((F.col("name") == "opacity") & F.col("value").isin("0", "0.0", "0.00"))
        | ((F.col("name") == "style") & (style.contains("display:none") | style.contains("visibility:hidden") | style.rlike(r"(^|;)opacity:0(\.0+)?(;|$)")))
    )
    hidden = found(attrs.where(hides).select("artifact_path", "element").distinct(), "hidden_element", "hidden", False)
    scripts = found(elements.where("tag = 'script'"), "security_issue", "script", False)
    data = found(attrs.where(F.lower(F.ltrim("value")).startswith("data:")), "structural_signal", "data uri", False)
    box = attrs.where("element = 0 AND name = 'viewBox'").select("artifact_path", F.transform(F.split(F.trim("value"), r"[\s,]+"), lambda v: v.try_cast("double")).alias("box"))
    box = box.where("size(box) = 4 AND box[2] > 0 AND box[3] > 0")
    limit = F.greatest(10 * F.abs(F.get("box", F.lit(0))), 10 * F.get("box", F.lit(2)), 10 * F.abs(F.get("box", F.lit(1))), 10 * F.get("box", F.lit(3)), F.lit(1000.0))
    placed = attrs.where(F.col("tag").isin(*SHAPES) & F.col("name").isin(*PLACES)).withColumn("at", F.regexp_extract("value", r"^[-+]?\d+(?:\.\d+)?", 0).try_cast("double"))
    far = found(placed.join(box, "artifact_path").where(F.abs("at") > limit).select("artifact_path", "element").distinct(), "structural_signal", "off canvas", False)
    copies = attrs.where("tag = 'path' AND name = 'd' AND value <> ''").groupBy("artifact_path", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = found(copies.select("artifact_path").distinct(), "structural_signal", "duplicate paths", False)
    used = attrs.select("artifact_path", F.explode(F.regexp_extract_all("value", F.lit(r"#([A-Za-z_][\w:.-]*)"), F.lit(1))).alias("id")).distinct()
    unused = attrs.where("name = 'id'").select("artifact_path", F.col("value").alias("id")).join(used, ["artifact_path", "id"], "left_anti").select("artifact_path").distinct()
    unused = found(unused.join(elements.where("tag = 'defs' AND depth = 2").select("artifact_path").distinct(), "artifact_path", "left_semi"), "structural_signal", "unreferenced ids", False)
    generators = found(notes.where(F.col("value").rlike(r"(?i)\b(generator|created with|exported by)\b")), "generator_metadata", "comment", ~_protected(F.col("value")))
    attributed = found(notes.withColumn("provider", _rule_hits("value", HTML_COMMENT)).where("provider is not null"), "explicit_ai_attribution", F.col("provider"), ~_protected(F.col("value")))
    out = blocks
    for df in (editors, hidden, scripts, data, far, copies, unused, generators, attributed):
        out = out.unionByName(df)
    return out


#: Images made of the parts.
_IMAGES = """SELECT p_partkey, concat('<svg xmlns="s" xmlns:inkscape="i" viewBox="0 0 10 10"', CASE WHEN p_partkey % 2 = 0 THEN ' inkscape:version="1"' ELSE '' END, '><defs><g id="a"/></defs>',
CASE WHEN p_partkey % 3 = 0 THEN '<metadata><rdf/></metadata>' ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN '<g style="display: none"/>' ELSE '' END, CASE WHEN p_partkey % 7 = 0 THEN '<rect x="5000"/>' ELSE '<rect x="5"/>' END,
CASE WHEN p_partkey % 4 = 0 THEN '<path d="M0"/><path d="M0"/>' ELSE '' END, CASE WHEN p_partkey % 6 = 0 THEN '<use href="#a"/>' ELSE '' END, CASE WHEN p_partkey % 11 = 0 THEN '<!-- created with ChatGPT -->' ELSE '' END,
CASE WHEN p_partkey % 13 = 0 THEN '<script/>' ELSE '' END, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE '</svg>' END) AS text FROM part"""


@query(
    "svg_findings",
    """WITH p AS (SELECT p_partkey AS k, concat('svg/', p_partkey) AS artifact_path FROM part WHERE p_partkey % 17 <> 0) SELECT * FROM (
      SELECT artifact_path, 'generator_metadata' AS category, 'metadata block' AS detail, true AS removable FROM p WHERE k % 3 = 0 UNION ALL SELECT artifact_path, 'generator_metadata', 'editor attributes', true FROM p WHERE k % 2 = 0 UNION ALL SELECT artifact_path, 'hidden_element', 'hidden', false FROM p WHERE k % 5 = 0
      UNION ALL SELECT artifact_path, 'structural_signal', 'off canvas', false FROM p WHERE k % 7 = 0 UNION ALL SELECT artifact_path, 'structural_signal', 'duplicate paths', false FROM p WHERE k % 4 = 0 UNION ALL SELECT artifact_path, 'structural_signal', 'unreferenced ids', false FROM p WHERE k % 6 <> 0
      UNION ALL SELECT artifact_path, 'generator_metadata', 'comment', true FROM p WHERE k % 11 = 0 UNION ALL SELECT artifact_path, 'explicit_ai_attribution', 'openai', true FROM p WHERE k % 11 = 0 UNION ALL SELECT artifact_path, 'security_issue', 'script', false FROM p WHERE k % 13 = 0)""",
)
def q_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = bound(spark, sf_dir, _IMAGES).select(F.concat(F.lit("svg/"), "p_partkey").alias("artifact_path"), "text")
    return svg_findings(svg_elements(images))
