"""Chunks, prompts, answers and documents: text in columns."""

from __future__ import annotations

from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

from millrace.errors import BadChunking, MissingTemplate
from millrace.profiles import Profile

ENTRY = "struct<fields:map<string,string>,confidence:double,field_confidences:map<string,double>,source_quote:string,needs_review:boolean>"


def size_chunks(text: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Windows of size characters that start every size - overlap; the last is short. Null and empty: none."""
    if overlap >= size or size <= 0 or overlap < 0:
        raise BadChunking(f"overlap {overlap} must be at least 0 and below size {size}")
    n = F.length(text)
    step = size - overlap
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def paragraph_chunks(text: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Paragraphs (split at blank lines) packed up to size characters; a chunk starts with the tail of the one
    before: its last paragraph, or the last overlap characters of it. Oversized paragraphs stay whole."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("cur"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        size_ = F.length(p)
        over = (acc["n"] + size_ > size) & (F.size(acc["cur"]) > 0)
        last = F.element_at(acc["cur"], -1)
        seed = F.array(F.when(F.length(last) > overlap, F.right(last, F.lit(overlap))).otherwise(last)) if overlap > 0 else none
        seeded = F.concat(seed, F.array(p))
        return F.when(over, F.struct(F.concat(acc["done"], F.array(F.array_join(acc["cur"], "\n\n"))).alias("done"), seeded.alias("cur"), F.aggregate(seeded, F.lit(0), lambda a, x: a + F.length(x)).alias("n"))).otherwise(
            F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.array(p)).alias("cur"), (acc["n"] + size_).alias("n"))
        )

    end = lambda acc: F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["cur"], "\n\n")))).otherwise(acc["done"])
    return F.coalesce(F.aggregate(paragraphs, start, step, end), none)


def chunk(df: DataFrame, text: str = "text", strategy: str = "paragraph", size: int = 2000, overlap: int = 200) -> DataFrame:
    """One row a chunk: df's columns but the text, chunk_index (from 0) and chunk."""
    made = {"paragraph": paragraph_chunks, "size": size_chunks}[strategy](F.col(text), size, overlap)
    return df.select(*[c for c in df.columns if c != text], F.posexplode(made).alias("chunk_index", "chunk"))


def field_table(profile: Profile) -> str:
    rows = [f"| {f.name} | {f.type} | {', '.join(f.aliases)} | {'yes' if f.required else 'no'} |" for f in profile.fields.values()]
    return "\n".join(["| field | type | also called | required |", "| --- | --- | --- | --- |", *rows])


GENERIC_PROMPT = "Read the text about {{asset_type}} and list its records as JSON.\n\nFields:\n{{field_table}}\n\nText:\n{{text}}\n"


def load_template(folder: str | None, name: str, generic: str = "generic") -> str:
    if folder is None:
        return GENERIC_PROMPT
    for n in (name, generic):
        if (p := Path(folder) / f"{n}.md").exists():
            return p.read_text(encoding="utf-8")
    raise MissingTemplate(f"{name} in {folder}")


def prompts(template: str, asset_type: str, profile: Profile, text: Column) -> Column:
    """The template with asset type, field table and text in place; the text goes in last and is not searched."""
    fixed = template.replace("{{asset_type}}", asset_type).replace("{{field_table}}", field_table(profile))
    parts = fixed.split("{{text}}")
    return F.concat(F.lit(parts[0]), *[x for p in parts[1:] for x in (text, F.lit(p))])


def parse_entries(answer: Column) -> Column:
    """array<entry> out of a JSON list, a JSON object, or the first fenced block with either; null when none parses."""
    fence = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)

    def read(c: Column) -> Column:
        t = F.trim(c)
        several = F.when(t.startswith("["), F.from_json(t, f"array<{ENTRY}>"))
        one = F.when(t.startswith("{"), F.from_json(t, ENTRY))
        return F.coalesce(several, F.when(one["fields"].isNotNull(), F.array(one)))

    return F.coalesce(read(answer), read(fence))


class Backend(Protocol):
    def answer(self, prompt: str) -> str: ...


class StubBackend:
    """A deterministic stand-in: one record whose only field is the number of words after the last line 'Text:'."""

    def __init__(self, field: str = "words", confidence: float = 0.9):
        self.field, self.confidence = field, confidence

    def answer(self, prompt: str) -> str:
        n = len(prompt.rpartition("Text:\n")[2].split())
        return f'[{{"fields": {{"{self.field}": "{n}"}}, "confidence": {self.confidence}}}]'


def extract(chunks: DataFrame, prompt: Column, backend: Backend, attempts: int = 3) -> DataFrame:
    """chunks' columns and the record's: each chunk is asked about up to attempts times until the answer parses."""
    import json
    import re

    asked = chunks.withColumn("_prompt", prompt)
    names = chunks.columns

    def ask(batches):
        for pdf in batches:
            out = []
            for p in pdf["_prompt"]:
                got = ""
                for _ in range(attempts):
                    got = backend.answer(p)
                    body = got.strip()
                    if not body.startswith(("[", "{")) and (m := re.search(r"```(?:json)?\s*(.*?)```", got, re.S)):
                        body = m[1]
                    try:
                        json.loads(body)
                        break
                    except ValueError:
                        got = ""
                out.append(got)
            yield pdf[names].assign(_answer=pd.Series(out, index=pdf.index, dtype="string"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    answered = asked.mapInPandas(ask, f"{fields}, _answer string")
    return answered.select(*names, F.explode(parse_entries(F.col("_answer"))).alias("e")).select(*names, "e.*")


def document_text(df: DataFrame, columns: list[str], units: dict[str, str] | None = None) -> Column:
    """'column: value unit' of the columns that aren't null, joined by '; '. Doubles have two decimals."""
    parts = []
    for c in columns:
        x = F.col(f"`{c}`")
        said = F.format_string("%.2f", x) if isinstance(df.schema[c].dataType, (DoubleType, FloatType)) else x.cast("string")
        unit = f" {units[c]}" if units and units.get(c) else ""
        parts.append(F.when(x.isNotNull(), F.concat(F.lit(f"{c}: "), said, F.lit(unit))))
    return F.concat_ws("; ", *parts)


def search(df: DataFrame, text: str, words: list[str]) -> DataFrame:
    """Rows whose text holds any of the words, whatever the case."""
    import re

    return df.where(F.col(text).rlike("(?iu)" + "|".join(re.escape(w) for w in words)))
