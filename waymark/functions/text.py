"""Scalar functions on ids, names, paths and URLs, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a one-element array binds it for the lambda, so
    that an expression that uses it often stays small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slug(text: Column, max_words: int = 8) -> Column:
    """Lower-case words joined by hyphens; 'item' for a text without any."""
    words = F.slice(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), 1, max_words)
    return F.when(F.size(words) > 0, F.array_join(words, "-")).otherwise("item")


def norm_url(url: Column) -> Column:
    """A literal URL path for matching: cut at the first ?, ${ or {; trailing slashes dropped; a
    numeric last part becomes {id}. Null unless it starts with / and has at most 400 characters."""
    bare = lambda u: F.when(u.startswith("/"), F.coalesce(F.nullif(F.rtrim(u, F.lit("/")), F.lit("")), F.lit("/")))
    path = let(F.regexp_replace(url, r"(?s)(\?|\$\{|\{).*$", ""), bare)
    return let(F.regexp_replace(path, r"/\d+$", "/{id}"), lambda u: F.when(F.length(u) <= 400, u))


def method_path(name: Column) -> Column:
    """Struct (method, path) of 'VERB path'; no verb: ('', name)."""
    name = F.coalesce(name, F.lit(""))
    verb = F.regexp_extract(name, r"^\s*(\S+)\s+\S", 1)
    is_verb = (verb != "") & (verb == F.upper(verb)) & verb.rlike("[A-Z]") & (F.length(verb) <= 7)
    return F.struct(
        F.when(is_verb, verb).otherwise("").alias("method"),
        F.when(is_verb, F.regexp_extract(name, r"(?s)^\s*\S+\s+(.*)$", 1)).otherwise(name).alias("path"),
    )


def simple_class(node_id: Column) -> Column:
    """Last : part, of it the last . part, of it what is before #."""
    return F.substring_index(F.substring_index(F.substring_index(node_id, ":", -1), ".", -1), "#", 1)


def walk_key(path: Column) -> Column:
    """Sort key of a top-down walk: in each folder files first, then folders, by name."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda x, i: F.struct(F.when(i == F.size(parts) - 1, 0).otherwise(1).alias("d"), x.alias("n")))


def glob_regex(pattern: str) -> str:
    """A shell pattern as a Java regular expression (* and ? cross slashes)."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif close > 0:
            inner = pattern[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = close
        else:
            out += "\\" + ch if not (ch.isalnum() or ch == "_") else ch
        i += 1
    return f"(?s)^{out}$"


def md_cell(text: Column) -> Column:
    """A Markdown table cell: pipes escaped, line ends folded."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "))


def extension(path: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(base, r"^.+(\.[^.]*)$", 1))


def stamp(time: Column) -> Column:
    """A moment as change records name it: date, hour and minute."""
    return F.date_format(time, "yyyy-MM-dd-HHmm")


def iso_seconds(time: Column) -> Column:
    """A moment in UTC as the graph's log writes it (the session's time zone has to be UTC)."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")
