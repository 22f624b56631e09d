"""Lexical search: query language, tokens, BM25 over words, phrases and prefixes, on tables or on a kept index."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import spool, spread
from . import index
from .matching import unlisted, word_lists

ACCENTED, PLAIN = "áéíóúàèìòùâêîôûäëïöüãõñç", "aeiouaeiouaeiouaeiouaonc"
K1, B = 1.2, 0.75
#: Columns that a search covers.
INDEXED = ("title", "content", "tool_name", "type", "project", "topic_key")


class QueryError(ValueError):
    """A query that the language does not allow."""


def fold(x: Column) -> Column:
    return F.translate(F.lower(x), ACCENTED, PLAIN)


def tokens(*cols: str) -> Column:
    text = F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in cols))
    return F.array_remove(F.split(fold(text), r"[^\p{L}\p{N}]+"), "")


def indexed(observations: DataFrame) -> Column:
    """Tokens of all searched columns that the table has."""
    return tokens(*(c for c in INDEXED if c in observations.columns))


def sanitize(query: str) -> str:
    """Quote bare words; operators and queries with special characters stay as they are."""
    query = query.strip()
    if any(c in query for c in '"*^()'):
        return query
    return " ".join(w if w in ("OR", "AND", "NOT") else f'"{w}"' for w in query.split())


@dataclass(frozen=True)
class Term:
    """Words next to one another; with ``prefix`` the last may go on, with ``initial`` the first stands at the start."""

    words: tuple[str, ...]
    prefix: bool = False
    initial: bool = False


def _lex(query: str) -> list:
    out, i, initial = [], 0, False
    while i < len(query):
        c = query[i]
        if c.isspace():
            i += 1
            continue
        if c == "^":
            if initial:
                raise QueryError("^ twice")
            initial, i = True, i + 1
            continue
        if c in "()":
            if initial:
                raise QueryError("^ must stand before a word or string")
            out.append(c)
            i += 1
            continue
        if c == '"':
            j = query.find('"', i + 1)
            if j < 0:
                raise QueryError("unterminated string")
            words, j, bare = query[i + 1 : j], j + 1, False
        else:
            j = i
            while j < len(query) and not query[j].isspace() and query[j] not in '()"*^':
                j += 1
            words, bare = query[i:j], True
            if not all(x.isalnum() or x == "_" for x in words):
                raise QueryError(f"column filters and signs are not allowed outside strings: {words!r}")
            if not words:
                raise QueryError("* must follow a word or string")
        star = query[j : j + 1] == "*"
        i = j + star
        if bare and words == "NEAR" and query[j : j + 1] == "(":
            raise QueryError("NEAR is not supported")
        if bare and words in ("OR", "AND", "NOT") and not star and not initial:
            out.append(words)
        else:
            out.append(Term(split_words(words), star, initial))
        initial = False
    if initial:
        raise QueryError("^ must stand before a word or string")
    return out


def split_words(text: str) -> tuple[str, ...]:
    folded = text.lower().translate(str.maketrans(ACCENTED, PLAIN))
    return tuple("".join(c if c.isalnum() else " " for c in folded).split())


def parse(query: str) -> tuple:
    """Tree of ('or' | 'and' | 'not', left, right) and Terms; binds by juxtaposition, NOT, AND, OR in this order."""
    lexed, at = _lex(query), 0

    def peek():
        return lexed[at] if at < len(lexed) else None

    def level(op: str, below):
        def run():
            nonlocal at
            left = below()
            while peek() == op:
                at += 1
                left = (op.lower(), left, below())
            return left
        return run

    def primary():
        nonlocal at
        x = peek()
        if x == "(":
            at += 1
            tree = lowest()
            if peek() != ")":
                raise QueryError("missing )")
            at += 1
            return tree
        if not isinstance(x, Term):
            raise QueryError(f"unexpected {x!r}")
        at += 1
        return x

    def near():
        left = primary()
        while isinstance(peek(), Term) or peek() == "(":
            left = ("and", left, primary())
        return left

    lowest = level("OR", level("AND", level("NOT", near)))
    if not lexed:
        raise QueryError("empty query")
    tree = lowest()
    if at < len(lexed):
        raise QueryError(f"unexpected {lexed[at]!r}")
    return tree


def joined(toks: str) -> Column:
    """Tokens between single spaces; they hold none, so neighbours are a substring."""
    return F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))


def matches(term: Term, toks: str = "toks") -> Column:
    """Whether the words occur next to one another; the last may be a prefix."""
    if not term.words:
        return F.lit(False)
    if len(term.words) == 1 and not term.prefix and not term.initial:
        return F.array_contains(toks, term.words[0])
    wanted = F.lit(" " + " ".join(term.words) + ("" if term.prefix else " "))
    return joined(toks).startswith(wanted) if term.initial else joined(toks).contains(wanted)


def frequency(term: Term, toks: str = "toks") -> Column:
    """How often the term occurs: positions at which all its words follow one another."""
    if not term.words:
        return F.lit(0)
    last = len(term.words) - 1

    def here(i: Column) -> Column:
        each = [F.get(toks, i + k).startswith(w) if term.prefix and k == last else F.get(toks, i + k) == w for k, w in enumerate(term.words)]
        return reduce(lambda a, b: a & b, each)

    if term.initial:
        return matches(term, toks).cast("int")
    if not last:
        (word,) = term.words
        return F.size(F.filter(toks, lambda t: t.startswith(word) if term.prefix else t == word))
    return F.when(matches(term, toks), F.size(F.filter(F.sequence(F.lit(0), F.size(toks) - 1), here))).otherwise(0)


def condition(tree, toks: str = "toks") -> Column:
    if isinstance(tree, Term):
        return matches(tree, toks)
    op, left, right = tree
    a, b = condition(left, toks), condition(right, toks)
    return a | b if op == "or" else a & b if op == "and" else a & ~b


def _met(tree, units: list[Term]) -> Column:
    """``condition`` from the frequencies tf0, tf1, ... of the units."""
    if isinstance(tree, Term):
        return F.col(f"tf{units.index(tree)}") > 0
    op, left, right = tree
    a, b = _met(left, units), _met(right, units)
    return a | b if op == "or" else a & b if op == "and" else a & ~b


def all_terms(tree) -> list[Term]:
    """Terms of the query, each once, in their order."""
    return [tree] if isinstance(tree, Term) else list(dict.fromkeys(all_terms(tree[1]) + all_terms(tree[2])))


def positive_terms(tree) -> list[Term]:
    if isinstance(tree, Term):
        return [tree]
    return positive_terms(tree[1]) + ([] if tree[0] == "not" else positive_terms(tree[2]))


def ranked(counted: DataFrame, units: list[Term], totals: tuple[int, float] | None = None) -> DataFrame:
    """``counted`` (dl, tf0, tf1, ...) with ``rank``: the sum over units, each word, phrase or prefix one; negative, lower is better.

    ``counted`` has all rows, or those with some unit where ``totals`` tells the
    number of all and their mean length.
    """
    whole = [F.lit(totals[0]).alias("n"), F.lit(totals[1]).alias("avgdl")] if totals else [F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")]
    stats = counted.agg(*whole, *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(units))))
    rank = F.lit(0.0)
    for i in range(len(units)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        x = F.col(f"tf{i}")
        rank = rank - idf * x * (K1 + 1) / (x + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    some = F.greatest(*(F.col(f"tf{i}") for i in range(len(units))), F.lit(0))
    return counted.filter(some > 0).crossJoin(F.broadcast(stats)).withColumn("rank", rank)  # one row


def counts(docs: DataFrame, units: list[Term], *keep: str) -> DataFrame:
    """Length and frequencies of each document, written once: tokens are made in one pass, and only numbers are kept."""
    return spool(docs.select("id", *keep, F.size("toks").alias("dl"), *(frequency(u).alias(f"tf{i}") for i, u in enumerate(units))), "counts")


def postings_of(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, tuple[int, float]]:
    """Postings (term, id, tf, dl) of the words of a table of terms (term), written once, and the number and mean length of all documents (id, toks)."""
    lists, totals = word_lists(docs, terms)
    return unlisted(lists), totals


def bm25(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(id, rank): negative, lower is better.  ``docs`` has id and toks; all of them count in the statistics."""
    units = [Term((w,)) for w in sorted(set(terms))]
    return ranked(counts(docs, units), units).select("id", "rank")


def visible_to(project: str | None) -> Column:
    """Live rows; of a project and global ones where one is named."""
    live = F.col("deleted_at").isNull()
    return live & ((F.col("project") == project) | (F.col("scope") == "global")) if project else live


def search(observations: DataFrame, query: str, project: str | None = None, limit: int = 20) -> DataFrame:
    """Ranked matches of a query among live rows, of a project and global ones where one is named.

    One pass over the texts; all rows count in the statistics.  Raises
    ``QueryError`` for an empty query, and for what the language leaves out.
    """
    tree = parse(sanitize(query))
    units = all_terms(tree)
    docs = spread(observations).select("id", visible_to(project).alias("ok"), indexed(observations).alias("toks"))
    found = ranked(counts(docs, units, "ok"), units).filter(F.col("ok") & _met(tree, units))
    return found.select("id", "rank").orderBy("rank", "id").limit(limit)


# --- inverted index ------------------------------------------------------------------------------


def notes(observations: DataFrame) -> DataFrame:
    """Observations as an index takes them; tables without visibility have only visible rows."""
    none = {"project": "string", "scope": "string", "deleted_at": "timestamp"}
    shown = [F.col(c) if c in observations.columns else F.lit(None).cast(kind).alias(c) for c, kind in none.items()]
    return observations.select("id", *shown, indexed(observations).alias("toks"))


def write_index(observations: DataFrame, path: str) -> None:
    """An index of all observations, as its first version."""
    index.create(notes(observations), path)


def update_index(path: str, changed: DataFrame, removed: DataFrame | None = None) -> None:
    """Bring an index up to date with observations that are new or changed, and ids (id) that are no longer there."""
    index.update(path, notes(changed), removed)


def search_index(spark: SparkSession, path: str, query: str, project: str | None = None, limit: int = 20) -> DataFrame:
    """``search`` on a kept index: only postings of the query's words are read, and only notes that have some are ranked."""
    tree = parse(sanitize(query))
    units = all_terms(tree)
    whole = sorted({w for u in units for k, w in enumerate(u.words) if not (u.prefix and k == len(u.words) - 1)})
    starts = sorted({u.words[-1] for u in units if u.prefix and u.words})
    posts, totals = index.postings(spark, path, index.any_of(whole, starts))
    # words of the query at their positions; others are gaps between them
    seen = F.first((~F.col("gone")) & ((F.col("project") == project) | (F.col("scope") == "global") if project else F.lit(True)))
    near = posts.groupBy("id").agg(F.first("dl").alias("dl"), seen.alias("ok"), F.collect_list(F.struct("term", "positions")).alias("p"))
    spots = F.flatten(F.transform("p", lambda p: F.transform(p["positions"], lambda x: F.struct(x.alias("pos"), p["term"].alias("term")))))
    near = near.select("id", "dl", "ok", F.map_from_entries(spots).alias("at"))

    def times(u: Term) -> Column:
        last = len(u.words) - 1

        def here(i: Column) -> Column:
            term = lambda k: F.element_at("at", i + k)
            each = [F.coalesce(term(k).startswith(w) if u.prefix and k == last else term(k) == w, F.lit(False)) for k, w in enumerate(u.words)]
            return reduce(lambda a, b: a & b, each)

        return F.size(F.filter(F.map_keys("at"), lambda i: here(i) & (i == 0) if u.initial else here(i))) if u.words else F.lit(0)

    rows = spool(near.select("id", "dl", "ok", *(times(u).alias(f"tf{i}") for i, u in enumerate(units))), "hits")
    found = ranked(rows, units, totals).filter(F.col("ok") & _met(tree, units))
    return found.select("id", "rank").orderBy("rank", "id").limit(limit)


# --- matches of all words, ranked by how near they stand --------------------------------------------


def _at(word: str):
    return lambda i: F.get("toks", i) == word


def _far(position: Column, weight: float):
    """What a pair of positions leaves to be ranked, the less the nearer they are."""

    def part(other: Column) -> Column:
        d = F.abs(position - other)
        near = F.when(d > 100, 1e-30).otherwise(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
        return 1.0 - F.sqrt(F.lit(weight * weight) * near)

    return part


def _left(a: str, b: str, weight: float) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda s, x: s * F.aggregate(b, F.lit(1.0), lambda u, y: u * _far(x, weight)(y)))


def distance_rank(docs: DataFrame, words: list[str], weight: float = 0.1) -> DataFrame:
    """(id, rank) of documents (id, toks) that have all words; higher is better.

    Every pair of positions of two different words adds to the rank, the more
    the nearer they stand; a single word is ranked by its occurrences, each
    counting less than the one before.
    """
    words = sorted(set(words))
    if not words:
        raise QueryError("empty query")
    has_all = reduce(lambda a, b: a & b, [F.array_contains("toks", w) for w in words])
    all_at = F.sequence(F.lit(0), F.size("toks") - 1)
    places = [F.filter(all_at, _at(w)).alias(f"at{k}") for k, w in enumerate(words)]
    hit = docs.filter(has_all).select("id", *places)
    if len(words) == 1:
        score = F.aggregate(F.sequence(F.lit(1), F.size("at0")), F.lit(0.0), lambda s, j: s + weight / (j * j))
        return hit.select("id", (score / 1.64493406685).alias("rank"))
    left = reduce(lambda a, b: a * b, [_left(f"at{k}", f"at{j}", weight) for k in range(len(words)) for j in range(k)])
    return hit.select("id", (1.0 - left).alias("rank"))
