"""Page content trees (JSON) rendered to Markdown.  The trees recurse, which a Spark schema can't, so one Arrow UDF walks them."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.kinds import ARTICLE_KINDS


def _wrapped(mark: str) -> Callable[[dict], str]:
    return lambda n: f"{mark}{inline(n.get('inlineContent'))}{mark}"


def _reference(n: dict) -> str:
    last = (n.get("identifier") or "").rsplit("/", 1)[-1].replace("-", " ")
    return f"`{n.get('title') or last or 'reference'}`"


INLINE: dict[str, Callable[[dict], str]] = {
    "text": lambda n: n.get("text") or "",
    "codeVoice": lambda n: f"`{n.get('code') or ''}`",
    "reference": _reference,
    "emphasis": _wrapped("*"),
    "strong": _wrapped("**"),
    "link": lambda n: f"[{n.get('title') or n.get('destination') or 'Link'}]({n.get('destination') or ''})",
}


def _nodes(value) -> list[dict]:
    return [n for n in value if isinstance(n, dict)] if isinstance(value, list) else []


def inline(value) -> str:
    """Inline nodes as Markdown; a node of another type gives its children, else its text."""
    other = lambda n: inline(n["inlineContent"]) if n.get("inlineContent") else n.get("text") or ""
    return "".join(INLINE.get(n.get("type"), other)(n) for n in _nodes(value))


def _list(mark: Callable[[int], str]) -> Callable[[dict], str]:
    return lambda n: "\n".join(f"{mark(i)} {blocks(item.get('content')).strip()}" for i, item in enumerate(_nodes(n.get("items")), 1))


def _quoted(text: str) -> str:
    return text.replace("\n", "\n> ")


def _aside(n: dict) -> str:
    text = blocks(n.get("content")).strip()
    return f"> [!{(n.get('style') or 'NOTE').upper()}]\n> {_quoted(text)}" if text else ""


def fenced(code: str, language: str | None) -> str:
    return f"```{language or 'swift'}\n{code}\n```"


BLOCKS: dict[str, Callable[[dict], str]] = {
    "paragraph": lambda n: inline(n.get("inlineContent")).strip(),
    "heading": lambda n: f"{'#' * min(6, max(1, n.get('level') or 2))} {n.get('text') or ''}",
    "codeListing": lambda n: fenced("\n".join(n["code"]) if isinstance(n.get("code"), list) else "", n.get("syntax")),
    "unorderedList": _list(lambda i: "-"),
    "orderedList": _list(lambda i: f"{i}."),
    "aside": _aside,
}


def blocks(value, most: int | None = None) -> str:
    made = (BLOCKS[n["type"]](n) for n in _nodes(value)[:most] if n.get("type") in BLOCKS)
    return "\n\n".join(x for x in made if x)


def short_blocks(value, most: int = 6, items: int = 8) -> str:
    """The first blocks only, headings of level 2 to 5, and the first items of lists."""
    cut = []
    for n in _nodes(value)[:most]:
        if n.get("type") == "heading":
            n = n | {"level": min(5, max(2, n.get("level") or 2))}
        elif n.get("type") in ("unorderedList", "orderedList"):
            n = n | {"items": _nodes(n.get("items"))[:items]}
        cut.append(n)
    return blocks(cut)


def declaration(sections) -> str | None:
    """The first declaration as fenced code."""
    for section in _nodes(sections):
        if section.get("kind") == "declarations":
            for d in _nodes(section.get("declarations"))[:1]:
                code = "".join(t.get("text") or "" for t in _nodes(d.get("tokens"))).strip()
                return fenced(code, (d.get("languages") or [None])[0]) if code else None
            return None
    return None


def deprecation(summary) -> str | None:
    text = blocks(summary).strip()
    return f"> [!WARNING]\n> **Deprecated**: {_quoted(text)}" if text else None


def parameters(sections) -> str | None:
    for section in _nodes(sections):
        if section.get("kind") == "parameters":
            described = ((p.get("name"), blocks(p.get("content")).strip()) for p in _nodes(section.get("parameters")))
            lines = [f"- `{name}`: {text}" if text else f"- `{name}`" for name, text in described]
            return "### Parameters\n" + "\n".join(lines) if lines else None
    return None


def discussion(sections) -> str | None:
    texts = [blocks(s.get("content")).strip() for s in _nodes(sections) if s.get("kind") == "content"]
    return "\n\n".join(t for t in texts if t) or None


def trimmed(text: str, most: int) -> str:
    return text if len(text) <= most else text[: max(0, most - 3)] + "..."


def topics(page: dict, most: int = 5) -> str | None:
    """The references that each topic names, `most` of them with the start of their abstract, and how many are left."""
    out, references = [], page.get("references") or {}
    for section in _nodes(page.get("topicSections")):
        named = section.get("identifiers") or []
        found = [references[i] for i in named[:most] if isinstance(references.get(i), dict)]
        lines = [f"• **{r.get('title')}** - {trimmed(''.join(p.get('text') or '' for p in _nodes(r.get('abstract'))), 100)}" for r in found]
        if len(named) > most:
            lines.append(f"*... and {len(named) - most} more items*")
        out.append("\n".join([f"### {section.get('title') or ''}".rstrip(), *lines]))
    return "\n\n".join(out) or None


def shown_platforms(items) -> str:
    return ", ".join(f"{p.get('name')} {p.get('introducedAt')}{' (Beta)' if p.get('beta') else ''}" for p in _nodes(items)) or "All platforms"


def page(value, concise: bool = False) -> str:
    """A page as Markdown, section by section; a concise one has neither discussion nor topics."""
    value = value if isinstance(value, dict) else {}
    meta, parts = value.get("metadata") or {}, value.get("primaryContentSections")
    facts = (("Type", meta.get("symbolKind") or meta.get("roleHeading") or meta.get("role") or "Unknown"), ("Platforms", shown_platforms(meta.get("platforms"))))
    sections = [f"# {meta.get('title') or 'Symbol'}", "\n".join(f"**{name}:** {text}" for name, text in facts), deprecation(value.get("deprecationSummary"))]
    told, overview = declaration(parts), "".join(p.get("text") or "" for p in _nodes(value.get("abstract")))
    sections += [told and f"## Declaration\n{told}", parameters(parts), overview and f"## Overview\n{overview}"]
    if not concise:
        more, listed = discussion(parts), topics(value)
        sections += [more and f"## Discussion\n{more}", listed and f"## Topics\n{listed}"]
    return "\n\n".join(s for s in sections if s)


def result_lines(row: dict) -> str:
    """One search result as Markdown."""
    platforms_ = ", ".join(row.get("platforms") or []) or "All platforms"
    framework = row.get("framework")
    lines = [
        f"### {row.get('title')}{f' ({framework})' if framework else ''}", f"   • **Kind:** {row.get('kind') or 'unknown'}", f"   • **Path:** `{row.get('path')}`", f"   • **Platforms:** {platforms_}",
        *([f"   {row['abstract']}"] if row.get("abstract") else []), *([f"   ![Visual Preview]({row['media_url']})"] if row.get("media_url") else []),
    ]
    return "\n".join(lines)


def results(query: str, rows: list[dict], facts: dict[str, str]) -> str:
    """A page of results, symbols before articles; rows are the top-k of a search, so few."""
    head = [f'# Search Results for "{query}"', "\n".join(f"**{k}:** {v}" for k, v in (facts | {"Matches Found": str(len(rows))}).items())]
    for title, articles in (("Symbols", False), ("Articles & Guides", True)):
        own = [result_lines(r) for r in rows if ((r.get("kind") or "").lower() in ARTICLE_KINDS) == articles]
        head += [f"## {title}", *own] if own else []
    return "\n\n".join(head)


RENDERERS = {"topics": topics, "page": page, "page_concise": lambda v: page(v, True), "inline": inline, "blocks": blocks, "short_blocks": short_blocks, "declaration": declaration, "deprecation": deprecation, "parameters": parameters, "discussion": discussion}


def render(raw: Column, how: str) -> Column:
    """JSON text rendered by one of RENDERERS; null for null, bad JSON or nothing to show."""
    fn = RENDERERS[how]

    def one(text: str | None) -> str | None:
        try:
            return (fn(json.loads(text)) or None) if text else None
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(one)

    return run(raw)


def platforms(items: Column) -> Column:
    """`name introduced (Beta)` of each platform, joined; built from array<struct<name, introducedAt, beta>>."""
    beta = lambda p: F.when(F.coalesce(p["beta"], F.lit(False)), F.lit(" (Beta)")).otherwise(F.lit(""))
    shown = F.array_join(F.transform(items, lambda p: F.concat(p["name"], F.lit(" "), p["introducedAt"], beta(p))), ", ")
    return F.when(F.size(F.coalesce(items, F.array())) > 0, shown).otherwise("All platforms")


def plain_text(parts: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(parts, F.array()), lambda p: F.coalesce(p["text"], F.lit(""))), "")
