"""Rule-based extraction of entities, relations and graphs from text.

Entities come from three passes in this order: capitalised phrases, quoted terms, single capitalised words inside a
sentence. A text's entities are numbered in the order passes and positions give them; of repeats, compared in lower case,
the first stays. Two forms: column expressions inside Spark's own engine (``find_entities`` and what builds on it; no
offsets), and an Arrow-batched function with offsets (``extract``). Word boundaries are those of ASCII letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns, word lists and confidences.
PHRASE = r"[A-Z][a-z]+(?:\s+(?:(?:of|the|de|van|von)\s+)?[A-Z][a-z]+)+"
QUOTED = r'["`]([^"`]+)["`]'
SINGLE = r"(?<=[a-z,.;:!?]\s)[A-Z][a-z]{2,}"
ORGANIZATION_WORDS = ("Inc", "Corp", "Ltd", "University", "Institute", "Foundation", "Company", "Organization", "Association", "Department", "Agency", "Committee")
LOCATION_WORDS = ("City", "State", "County", "River", "Mountain", "Lake", "Ocean", "Sea", "Island", "Park", "Street")
NOT_VERBS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "into", "through", "during", "before", "after", "above", "below", "between", "under", "over")
VERB_PATTERNS = (r"^(?:,?\s*who\s+)?(\w+ed)\s", r"^(?:,?\s*who\s+)?(\w+s)\s", r"^(?:,?\s*who\s+)?(\w+)\s", r"^(\w+ed)$", r"^(\w+s)$", r"^(\w+)$")
IS_A = r"^(?:is|was|were|are)\s+(?:a|an|the)\s+"
SENTENCE_END = r"[.!?]+"
PHRASE_CONFIDENCE, QUOTED_CONFIDENCE, SINGLE_CONFIDENCE = 0.75, 0.7, 0.55
IS_A_CONFIDENCE, PAST_CONFIDENCE, PRESENT_CONFIDENCE, VERB_CONFIDENCE = 0.85, 0.75, 0.7, 0.6
_EDGE = (r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])")


def entity_type(text: Column) -> Column:
    """The first indicator word decides; else two or three words are a person."""
    words = F.split(text, r"\s+")
    hint = F.filter(words, lambda w: w.isin(*ORGANIZATION_WORDS, *LOCATION_WORDS))
    first = F.get(hint, F.lit(0))
    return F.when(first.isin(*ORGANIZATION_WORDS), "ORGANIZATION").when(first.isNotNull(), "LOCATION").when(F.size(words).between(2, 3), "PERSON").otherwise("ENTITY")


def find_entities(docs: DataFrame, doc_id: str, text: str, passes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, n, entity_id, entity, type, confidence: one row per entity."""
    patterns = {1: (_EDGE[0] + "(" + PHRASE + ")" + _EDGE[1], PHRASE_CONFIDENCE), 2: (QUOTED, QUOTED_CONFIDENCE), 3: ("(" + SINGLE + ")" + _EDGE[1], SINGLE_CONFIDENCE)}

    def matches(p: int) -> Column:
        texts = F.regexp_extract_all(F.col(text), F.lit(patterns[p][0]), F.lit(1))
        return F.transform(texts, lambda t: F.struct(F.lit(p).alias("pass"), t.alias("entity")))

    every = F.filter(F.concat(*[matches(p) for p in passes]), lambda e: e["entity"] != "")
    rows = docs.filter(F.col(text).isNotNull()).select(doc_id, F.posexplode(every).alias("at", "e")).select(doc_id, "at", "e.*", F.lower("e.entity").alias("key"))
    first = rows.groupBy(doc_id, "key").agg(F.min(F.struct("at", "pass", "entity")).alias("m")).select(doc_id, "m.*")
    n = F.row_number().over(Window.partitionBy(doc_id).orderBy("at")) - 1
    kind = F.when(F.col("pass") == 1, entity_type(F.col("entity"))).when(F.col("pass") == 2, "CONCEPT").otherwise("ENTITY")
    conf = F.when(F.col("pass") == 1, PHRASE_CONFIDENCE).when(F.col("pass") == 2, QUOTED_CONFIDENCE).otherwise(SINGLE_CONFIDENCE)
    return first.withColumn("n", n).select(doc_id, "n", F.concat(F.lit("ent_"), F.col("n").cast("string")).alias("entity_id"), "entity", kind.alias("type"), conf.alias("confidence"))


def keep_entities(entities: DataFrame, types: tuple[str, ...] | None = None, least: float = 0.5) -> DataFrame:
    """Numbers are given before this filter, so gaps may appear."""
    if types is not None:
        entities = entities.filter(F.col("type").isin(*types))
    return entities.filter(F.col("confidence") >= least)


def sentences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, sentence_no, sentence in lower case; blank ones are left out."""
    parts = F.filter(F.split(F.col(text), SENTENCE_END), lambda s: F.trim(s) != "")
    return docs.filter(F.col(text).isNotNull()).select(doc_id, F.posexplode(parts).alias("sentence_no", "s")).select(doc_id, "sentence_no", F.lower("s").alias("sentence"))


def sentence_pairs(docs: DataFrame, doc_id: str, text: str, entities: DataFrame) -> DataFrame:
    """Pairs (a before b in number) of a document's entities that occur in one sentence, with the sentence."""
    per = entities.select(doc_id, "n", "entity_id", F.lower("entity").alias("key"))
    per = per.groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct("n", "entity_id", "key"))).alias("es"))  # a document's own entities
    here = sentences(docs, doc_id, text).join(per, doc_id)
    here = here.withColumn("es", F.filter("es", lambda e: F.col("sentence").contains(e["key"]))).filter(F.size("es") > 1)
    one = here.select(doc_id, "sentence_no", "sentence", "es", F.explode("es").alias("a"))
    two = one.select(doc_id, "sentence_no", "sentence", "a", F.explode(F.filter("es", lambda e: e["n"] > F.col("a.n"))).alias("b"))
    return two.select(doc_id, "sentence_no", "sentence", F.col("a.entity_id").alias("subject_id"), F.col("a.key").alias("subject"), F.col("b.entity_id").alias("object_id"), F.col("b.key").alias("object"))


RELATION = "sentence_no int, subject_id string, predicate string, object_id string, confidence double"
EXTRACTED = "struct<entities:array<struct<id:string,text:string,type:string,confidence:double,start:int,end:int>>,relationships:array<struct<subjectId:string,predicate:string,objectId:string,confidence:double>>,contextGraph:map<string,array<string>>>"
_PY = tuple(re.compile(p, re.ASCII) for p in (r"\b(" + PHRASE + r")\b", QUOTED, "(" + SINGLE + r")\b"))
_PY_VERBS = tuple(re.compile(p, re.ASCII) for p in VERB_PATTERNS)
_PY_IS_A, _PY_END = re.compile(IS_A, re.ASCII), re.compile(SENTENCE_END)


def _type_of(text: str) -> str:
    words = text.split()
    for w in words:
        if w in ORGANIZATION_WORDS:
            return "ORGANIZATION"
        if w in LOCATION_WORDS:
            return "LOCATION"
    return "PERSON" if len(words) in (2, 3) else "ENTITY"


def _between(sentence: str, a: str, b: str) -> str | None:
    i, j = sentence.find(a), sentence.find(b)
    start, end = min(i + len(a), j + len(b)), max(i, j)
    if min(i, j) < 0 or start >= end:
        return None
    gap = sentence[start:end].strip(" \t\n\r\f\v")
    if _PY_IS_A.search(gap):
        return "is_a"
    return next((m[1] for p in _PY_VERBS if (m := p.search(gap)) and m[1] not in NOT_VERBS), None)


def entities_of(text: str, passes: tuple[int, ...] = (1, 2, 3)) -> list[dict]:
    """The numbered entities of one text, with offsets."""
    seen, entities = set(), []
    for p in passes:
        kind, conf = ((None, PHRASE_CONFIDENCE), ("CONCEPT", QUOTED_CONFIDENCE), ("ENTITY", SINGLE_CONFIDENCE))[p - 1]
        for m in _PY[p - 1].finditer(text):
            if m[1] and (key := m[1].lower()) not in seen:
                seen.add(key)
                entities.append({"id": f"ent_{len(entities)}", "text": m[1], "type": kind or _type_of(m[1]), "confidence": conf, "start": m.start(1), "end": m.end(1)})
    return entities


def relations_of(text: str, entities: list[dict]) -> Iterator[tuple[int, str, str, str, float]]:
    """(sentence_no, subject, predicate, object, confidence) of a text's entities that stand in one sentence, a before b in number.

    What stands between the first occurrences of two is ``is_a``, else the first verb of the patterns, else nothing.
    """
    keys = [(e["id"], e["text"].lower()) for e in entities]
    no = -1
    for sentence in _PY_END.split(text.lower()) if len(keys) > 1 else ():
        if not sentence.strip(" "):
            continue
        no += 1
        here = [x for x in keys if x[1] in sentence]
        for n, (a, ka) in enumerate(here):
            for b, kb in here[n + 1 :]:
                if p := _between(sentence, ka, kb):
                    yield no, a, p, b, IS_A_CONFIDENCE if p == "is_a" else PAST_CONFIDENCE if p.endswith("ed") else PRESENT_CONFIDENCE if p.endswith("s") else VERB_CONFIDENCE


def graph_of(relations: list[tuple]) -> dict[str, list[str]]:
    """Both directions of the relations, distinct, in the order in which they came up."""
    graph: dict[str, list[str]] = {}
    for _, a, _, b, _ in relations:
        for x, y in ((a, b), (b, a)):
            if y not in graph.setdefault(x, []):
                graph[x].append(y)
    return graph


def extract_text(text: str, types: tuple[str, ...] | None = None, least: float = 0.5, infer: bool = True) -> dict:
    """Entities with offsets, relations and graph of one text."""
    entities = [e for e in entities_of(text) if (types is None or e["type"] in types) and e["confidence"] >= least]
    found = list(relations_of(text, entities)) if infer else []
    rels = [{"subjectId": a, "predicate": p, "objectId": b, "confidence": c} for _, a, p, b, c in found]
    return {"entities": entities, "relationships": rels, "contextGraph": graph_of(found)}


def _by_text(docs: DataFrame, doc_id: str, text: str, schema: str, make) -> DataFrame:
    """Rows that ``make`` gives for each text, in one Arrow-batched pass: nothing of a document leaves its row, so nothing is shuffled."""
    rows = docs.filter(F.col(text).isNotNull()).select(doc_id, text)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, *row) for i, t in zip(b[doc_id], b[text]) for row in make(t)]
            yield pd.DataFrame(out, columns=[doc_id, *names])

    return rows.mapInPandas(run, f"{doc_id} {rows.schema[doc_id].dataType.simpleString()}, {schema}")


def relations(docs: DataFrame, doc_id: str, text: str, passes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, sentence_no, subject_id, predicate, object_id, confidence; the same pair again in another sentence stays."""
    return _by_text(docs, doc_id, text, RELATION, lambda t: relations_of(t, entities_of(t, passes)))


def context_graph(docs: DataFrame, doc_id: str, text: str, passes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, node, neighbours: in the order in which they came up."""
    return _by_text(docs, doc_id, text, "node string, neighbours array<string>", lambda t: graph_of(list(relations_of(t, entities_of(t, passes)))).items())


def extract(docs: DataFrame, doc_id: str, text: str, types: tuple[str, ...] | None = None, least: float = 0.5, infer: bool = True) -> DataFrame:
    """doc_id, extracted (see EXTRACTED): the nested form in one Arrow-batched pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({doc_id: b[doc_id], "extracted": [extract_text(t, types, least, infer) for t in b[text]]})

    rows = docs.filter(F.col(text).isNotNull()).select(doc_id, text)
    return rows.mapInPandas(run, f"{doc_id} {rows.schema[doc_id].dataType.simpleString()}, extracted {EXTRACTED}")
