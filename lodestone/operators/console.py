"""Commands and endpoints over a catalogue: what a command line or a web route calls.  Parameters come as untrusted text; each answer is a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import contains_folded
from lodestone.operators import diagnose, health, hybrid

#: The words that begin a command, by command.  Any other text is a search by meaning, no text the demo.
WORDS = {
    "demo": ("demo",),
    "status": ("status", "info", "version"),
    "index": ("index", "index_info", "indexinfo"),
    "frameworks": ("frameworks", "tech", "discover"),
    "idiom": ("idiom", "translate", "bridge"),
    "doc": ("doc", "symbol"),
    "diagnose": ("diagnose",),
    "search": ("search",),
}
COMMAND_OF = {word: name for name, words in WORDS.items() for word in words}
#: Results shown by a command.
SHOWN, SHOWN_IDIOMS = 8, 6
BUILD = r"\b(swift|xcodebuild)\b"


@dataclass(frozen=True)
class Catalogue:
    """The tables that commands read; `index` is a stored full-text index, `embed` makes the vector of a query (without it searches are lexical)."""

    symbols: DataFrame
    vectors: DataFrame
    pages: DataFrame
    rules: DataFrame
    migrations: DataFrame
    index: str | None = None
    embed: Callable[[str], Sequence[float]] | None = None


def choice(value: object) -> str | None:
    """A filter's value: nothing for none, blanks and `all`."""
    text = "" if value is None else str(value).strip()
    return text if text and text.lower() != "all" else None


def parse(line: str | None) -> tuple[str, str]:
    """(command, rest).  A line that begins with no command word is the command `semantic` with the whole line."""
    text = (line or "").strip()
    if not text:
        return "demo", ""
    word, *more = text.split(None, 1)
    rest = more[0] if more else ""
    name = COMMAND_OF.get(word.lower())
    if name is None or name == "demo" and rest:
        return "semantic", text
    return name, rest


def status(of: Catalogue) -> DataFrame:
    return health.index_info(of.symbols, of.vectors)


def search(of: Catalogue, q: object = "", mode: object = "semantic", framework: object = None, platform: object = None, kind: object = None, limit: object = 20) -> DataFrame:
    """hybrid.search with defaults for what is missing or malformed; lexical for that mode and for wildcards; the names of the rules that the query meets are searched as well otherwise."""
    text = str(q or "").strip()
    options = {"framework": choice(framework), "platform": choice(platform), "kind": choice(kind), "limit": hybrid.clamp_limit(limit), "index": of.index}
    if str(mode or "").strip().lower() == "lexical" or any(c in text for c in "*?"):
        return hybrid.search(of.symbols, of.vectors, text, lexical_only=True, **options)
    return hybrid.expanded_search(of.symbols, of.vectors, text, of.rules, query_vector=of.embed(text) if of.embed else None, prefer_semantic=True, **options)


def doc(of: Catalogue, path: object, framework: object = None) -> DataFrame:
    """The row that a title or path resolves to, with its page.  An empty path is an error."""
    if not (text := str(path or "").strip()):
        raise ValueError("a title or path is required")
    return hybrid.lookup(of.symbols, of.pages, text, choice(framework))


def idioms(of: Catalogue, ecosystem: object = None, q: object = None) -> DataFrame:
    return hybrid.rule_list(of.rules, choice(ecosystem), str(q or "").strip())


def diagnosed(of: Catalogue, output: object = "", command: object = "swift build", returncode: object = 1, marker: str = "[grounded]") -> DataFrame:
    """diagnose.ground of one build's output, if the gate lets it pass.  A return code that is no number counts as 1."""
    try:
        code = 1 if returncode is None else int(returncode)
    except (TypeError, ValueError):
        code = 1
    event = of.symbols.sparkSession.createDataFrame([(0, str(command or "swift build"), str(output or ""), code)], "log_id int, command string, output string, returncode int")
    logs = diagnose.hook_gate(event, BUILD, marker).select("log_id", F.col("output").alias("log"))
    return diagnose.ground(logs, of.symbols, of.migrations)


def frameworks(of: Catalogue, needle: str = "") -> DataFrame:
    """Frameworks whose name holds the needle, with their rows."""
    return health.count_by(of.symbols, "framework", contains_folded(F.col("framework"), needle) if needle else None)


def demo(of: Catalogue, wildcard: str, query: str, log: str) -> DataFrame:
    """(stage, item, detail): totals, a wildcard, a search and a diagnosis, as one table."""
    text = lambda c: F.col(c).cast("string")
    totals = status(of).select(F.lit("status").alias("stage"), F.lit("symbols").alias("item"), text("n").alias("detail"))
    hits = [search(of, q, mode, limit=SHOWN).select(F.lit(stage).alias("stage"), text("id").alias("item"), F.col("title").alias("detail")) for stage, q, mode in (("wildcard", wildcard, "lexical"), ("search", query, "semantic"))]
    found = diagnosed(of, log).select(F.lit("diagnose").alias("stage"), F.col("name").alias("item"), F.col("target").alias("detail"))
    return totals.unionByName(hits[0]).unionByName(hits[1]).unionByName(found)


def dispatch(of: Catalogue, line: str | None, wildcard: str = "*", query: str = "", log: str = "") -> DataFrame:
    """The answer to a command line.  `wildcard`, `query` and `log` are what the demo shows, and what `search` and `diagnose` take where the line names nothing."""
    name, rest = parse(line)
    answers: dict[str, Callable[[], DataFrame]] = {
        "demo": lambda: demo(of, wildcard, query, log),
        "status": lambda: status(of),
        "index": lambda: health.distribution(of.symbols, F.lower("kind")),
        "frameworks": lambda: frameworks(of, rest),
        "idiom": lambda: search(of, rest, limit=SHOWN_IDIOMS) if rest else hybrid.rule_table(of.rules),
        "doc": lambda: doc(of, rest),
        "diagnose": lambda: diagnosed(of, rest or log),
        "search": lambda: search(of, rest or query, "lexical", limit=SHOWN),
        "semantic": lambda: search(of, rest, limit=SHOWN),
    }
    return answers[name]()
