"""Schemas of the persistent tables and the constant relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCE_DOC = "id long, title string, type string, path string, engine string, canvasProfileId string, canvasTransform struct<scaleX:double,scaleY:double,offsetX:double,offsetY:double,rotation:double,flipY:boolean>, canvasMatchScore double, pages int, createdAt timestamp"
BLOCK = "id long, sourceDocId long, page int, bbox string, role string, text string, tableJson string, hash string"
METHODOLOGY = "id long, title string, version string"
FRAME = "id long, methodologyId long, name string, slug string, `order` int"
FIELD = "id long, frameId long, name string, slug string, description string, `order` int"

# Frame templates (slug, name, fields), in display order.
FRAMES = (
    ("platform-experience", "Platform Experience", ("Stakeholder", "Services", "Key Expectations", "Motivation", "Key Resources", "Alternatives", "Satisfaction Drivers Success Factors", "Attract", "Touchpoints", "CRM", "Key Insights", "Basic", "Delight")),
    ("ecosystem-forces-scan", "Ecosystem Forces Scan", ("Environment", "Market", "Macroeconomic", "Value Chain", "Emerging Needs")),
    ("platform-business-model", "Platform Business Model", ("Mission", "Core Services", "Core Value Proposition", "Core Network Effects", "Consumers", "Producers", "Value Capture", "Cost Structure", "Key People Skills", "Key Data", "Key Infrastructure", "Supporters", "Investors", "Suppliers", "USP", "TAM", "SAM", "SOM")),
    ("nfx-reinforcement-engines", "NFX Reinforcement Engines", ("Demand Side", "Supply Side", "Core Value", "Brand Loyalty", "Tech Infrastructure", "Economy of Scale", "Experience Personal Social", "Ecosystem Sustainability", "Data Intelligence")),
    ("platform-value-network", "Platform Value Network", ("Consumers", "Producers", "Partners", "Owners", "Value Propositions", "Transactions")),
)
TARGET_FRAMES = ("platform-experience", "platform-business-model")

# The zones of the business-model canvas, 1000 by 1400.
ZONES = (
    ("core-services", "Core Services", ((60, 260), (460, 260), (460, 520), (60, 520))),
    ("core-value-proposition", "Core Value Proposition", ((540, 260), (940, 260), (940, 520), (540, 520))),
    ("value-capture", "Value Capture", ((60, 560), (460, 560), (460, 800), (60, 800))),
    ("cost-structure", "Cost Structure", ((540, 560), (940, 560), (940, 800), (540, 800))),
)
CANVAS = (1000.0, 1400.0)


def frame_fields(spark: SparkSession, frames: tuple = FRAMES) -> DataFrame:
    """The template relation: frame_pos, slug, frame, field_pos, field."""
    rows = [(i, slug, name, j, field) for i, (slug, name, fields) in enumerate(frames) for j, field in enumerate(fields)]
    return spark.createDataFrame(rows, "frame_pos int, slug string, frame string, field_pos int, field string")


def target_fields(spark: SparkSession) -> DataFrame:
    """The fields that assignment looks for."""
    return frame_fields(spark, tuple(f for f in FRAMES if f[0] in TARGET_FRAMES))


def zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, [list(map(float, p)) for p in poly]) for i, n, poly in ZONES], "zone string, name string, polygon array<array<double>>")
