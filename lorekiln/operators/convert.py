"""Conversions between representations: structured form to markdown, vector to markdown by neighbours, text to vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.functions.text import title_of
from lorekiln.functions.timing import iso_to_ms
from lorekiln.functions.vectors import is_usable, sine_embedder
from lorekiln.operators.catalog import filter_concepts
from lorekiln.operators.extract import extract
from lorekiln.operators.search import search
from lorekiln.operators.validate import live_form_rules, require

#: The two shapes of a structured form.
LIVE_FORM = (
    "struct<id:string,rawText:string,language:string,metadata:struct<createdAt:string,updatedAt:string,author:string,tags:array<string>,source:string>,"
    "entities:array<struct<id:string,text:string,type:string,confidence:double,offset:struct<start:int,end:int>>>,"
    "relationships:array<struct<subjectId:string,predicate:string,objectId:string,confidence:double>>,contextGraph:map<string,array<string>>>"
)
SYNC_FORM = (
    "struct<schemaVersion:string,id:string,rawText:string,entities:array<struct<id:string,type:string,value:string,confidence:double>>,"
    "relationships:array<struct<id:string,type:string,from:string,to:string,weight:double>>,"
    "metadata:struct<createdAtMs:bigint,updatedAtMs:bigint,source:string,sourceDeviceId:string,authorPrincipal:string,contentHash:string,redaction:struct<rawTextOmitted:boolean>,tombstone:boolean>>"
)
#: The texts of the reconstruction template.
NO_NEIGHBOURS = "# Reconstructed Concept\n\nNo neighboring concepts available for reconstruction."
NO_CONTEXT = "[No neighbor context available]"
HEAD = "# Reconstructed Concept\n\n*Reconstructed from nearest-neighbor context.*\n\n"


def parse_form(json: Column) -> Column:
    """struct(live, sync, shape): the text read as the shape it has; both null and shape ``unreadable`` if it has none."""
    ok = F.try_parse_json(json).isNotNull()
    is_sync = F.get_json_object(json, "$.schemaVersion").isNotNull()
    shape = F.when(json.isNull(), F.lit(None)).when(~ok, "unreadable").when(is_sync, "sync").otherwise("live")
    return F.struct(F.when(shape == "live", F.from_json(json, LIVE_FORM)).alias("live"), F.when(shape == "sync", F.from_json(json, SYNC_FORM)).alias("sync"), shape.alias("shape"))


def live_from_sync(f: Column) -> Column:
    """rawText, entities and relations of a sync-shape form under the names of the live shape."""
    ents = F.transform(f["entities"], lambda e: F.struct(e["id"].alias("id"), e["value"].alias("text"), e["type"].alias("type"), e["confidence"].alias("confidence")))
    rels = F.transform(f["relationships"], lambda r: F.struct(r["from"].alias("subjectId"), r["type"].alias("predicate"), r["to"].alias("objectId"), r["weight"].alias("confidence")))
    return F.struct(f["id"].alias("id"), f["rawText"].alias("rawText"), ents.alias("entities"), rels.alias("relationships"))


def read_forms(concepts: DataFrame, namespace: str | None = None, tags: tuple[str, ...] = (), since_ms: int | None = None) -> DataFrame:
    """id, shape, ts, live, sync of the readable forms in a namespace, with all the tags, changed after a time (the form's own)."""
    rows = filter_concepts(concepts, namespace, tags).filter(F.col("thoughtform").isNotNull()).select("id", parse_form(F.col("thoughtform")).alias("f"))
    rows = rows.filter(F.col("f.shape") != "unreadable").select("id", "f.shape", F.coalesce("f.sync.metadata.updatedAtMs", iso_to_ms(F.col("f.live.metadata.updatedAt"))).alias("ts"), "f.live", "f.sync")
    return rows if since_ms is None else rows.filter(F.col("ts") > since_ms)


def form_to_markdown(f: Column) -> Column:
    """Title, text, and lists of entities and relations, each section only if it has entries; null without raw text.
    An entity without a confidence, which the sync shape allows, is listed without one."""
    name = lambda id_: F.coalesce(F.get(F.filter(f["entities"], lambda e: e["id"] == id_), F.lit(0))["text"], id_)
    ents = F.transform(f["entities"], lambda e: F.concat(F.lit("- **"), e["text"], F.lit("** ("), e["type"], F.when(e["confidence"].isNotNull(), F.concat(F.lit(", confidence: "), F.format_string("%.2f", e["confidence"]))).otherwise(""), F.lit(")")))
    rels = F.transform(f["relationships"], lambda r: F.concat(F.lit("- "), name(r["subjectId"]), F.lit(" **"), r["predicate"], F.lit("** "), name(r["objectId"])))
    section = lambda title, rows: F.when(F.size(rows) > 0, F.concat(F.lit(f"\n\n## {title}\n\n"), F.array_join(rows, "\n"))).otherwise("")
    return F.concat(F.lit("# "), title_of(f["rawText"]), F.lit("\n\n"), f["rawText"], section("Entities", ents), section("Relationships", rels))


def neighbour_texts(concepts: DataFrame, wanted: DataFrame, k: int = 5, namespace: str | None = "default", coarse: bool = False) -> DataFrame:
    """id, texts: of each wanted concept (id, embedding) the texts of its nearest others, closest first.

    As in ``search``: the closest 3k of all are looked at, of which those in the namespace count, at most k, itself included.
    """
    hits = search(concepts, wanted.select(F.col("id").alias("query"), "embedding"), k, namespace, coarse=coarse)
    raw = F.get_json_object("thoughtform", "$.rawText")
    text = concepts.select("id", F.coalesce("markdown", raw).alias("text")).filter(F.col("text") != "")
    near = hits.filter(F.col("query") != F.col("id")).join(text, "id")
    per = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "id", "text"))).alias("t")).select(F.col("query").alias("id"), F.col("t.text").alias("texts"))
    return wanted.select("id").join(per, "id", "left").select("id", F.coalesce("texts", F.array().cast("array<string>")).alias("texts"))


def reconstruct(texts: Column) -> Column:
    """Markdown from neighbour texts without a language model: a template for none, one or several."""
    parts = F.transform(texts, lambda t, i: F.concat(F.lit("## Related Context "), (i + 1).cast("string"), F.lit("\n\n"), t))
    return F.when(F.size(texts) == 0, NO_NEIGHBOURS).when(F.size(texts) == 1, F.concat(F.lit(HEAD), F.get(texts, F.lit(0)))).otherwise(F.concat(F.lit(HEAD), F.array_join(parts, "\n\n")))


def text_to_vector(text: Column, dim: int, model=None) -> Column:
    """``model`` makes a vector function for a dimension; by default the deterministic stand-in."""
    return (model or sine_embedder)(dim)(text)


def live_form(id_: Column, text: Column, extracted: Column, now_ms: int) -> Column:
    """The structured form that is made from a text and what was extracted from it."""
    at = F.date_format(F.timestamp_millis(F.lit(now_ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    meta = F.struct(at.alias("createdAt"), at.alias("updatedAt"), F.lit(None).cast("string").alias("author"), F.array().cast("array<string>").alias("tags"), F.lit("converted").alias("source"))
    ents = F.transform(extracted["entities"], lambda e: F.struct(e["id"].alias("id"), e["text"].alias("text"), e["type"].alias("type"), e["confidence"].alias("confidence"), F.struct(e["start"].alias("start"), e["end"].alias("end")).alias("offset")))
    return F.struct(id_.alias("id"), text.alias("rawText"), F.lit("en").alias("language"), meta.alias("metadata"), ents.alias("entities"), extracted["relationships"].alias("relationships"), extracted["contextGraph"].alias("contextGraph"))


def form_from_text(texts: DataFrame, text: str, now_ms: int, extractor=None, check: bool = True) -> DataFrame:
    """id, thoughtform of texts (id, ``text``): a whole form; with ``check`` one that breaks the rules of forms ends the job."""
    rows = texts.select("id", text)
    got = (extractor or extract)(rows, "id", text)
    made = rows.join(got, "id").select("id", live_form(F.col("id"), F.col(text), F.col("extracted"), now_ms).alias("_form"))
    if check:
        made = require(made, live_form_rules(F.col("_form")))
    return made.select("id", F.to_json("_form").alias("thoughtform"))


def convert(concepts: DataFrame, source: str, target: str, dim: int = 64, model=None, extractor=None, now_ms: int = 0, check: bool = True, coarse: bool = False) -> DataFrame:
    """id and the target representation of every concept that has the source one. Unknown or equal pairs are an error.

    Vectors that are not ``dim`` finite numbers count as none. ``check``: forms made from markdown must keep the rules of forms.
    ``coarse``: the neighbours of vectors are looked for in coarse cells, which many concepts need; else exactly.
    """
    pair = (source, target)
    if source == target:
        raise ValueError("source and target are the same")
    if pair == ("markdown", "vector"):
        return concepts.filter(F.trim("markdown") != "").select("id", text_to_vector(F.col("markdown"), dim, model).alias("embedding"))
    form = parse_form(F.col("thoughtform"))
    raw = F.coalesce(form["live"]["rawText"], form["sync"]["rawText"])
    if pair == ("thoughtform", "vector"):
        return concepts.withColumn("raw", raw).filter(F.col("raw") != "").select("id", text_to_vector(F.col("raw"), dim, model).alias("embedding"))
    if pair == ("thoughtform", "markdown"):
        f = concepts.select("id", form.alias("f"))
        return f.select("id", F.coalesce(form_to_markdown(F.col("f.live")), form_to_markdown(live_from_sync(F.col("f.sync")))).alias("markdown")).filter(F.col("markdown").isNotNull())
    if pair == ("markdown", "thoughtform"):
        return form_from_text(concepts.filter(F.col("markdown") != ""), "markdown", now_ms, extractor, check)
    if source == "vector" and target in ("markdown", "thoughtform"):
        have = concepts.filter(is_usable(F.col("embedding"), dim))
        texts = neighbour_texts(have, have.select("id", "embedding"), coarse=coarse)
        if target == "markdown":
            return texts.select("id", reconstruct(F.col("texts")).alias("markdown"))
        joined = texts.select("id", F.when(F.size("texts") > 0, F.array_join("texts", "\n\n")).otherwise(NO_CONTEXT).alias("text"))
        return form_from_text(joined, "text", now_ms, extractor, check=False)
    raise ValueError(f"no conversion from {source} to {target}")
