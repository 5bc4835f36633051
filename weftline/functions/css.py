"""CSS selectors as predicates over the node table."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_PART = re.compile(
    r"(?P<tag>^[a-zA-Z][\w-]*|^\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[(?P<attr>[\w-]+\*?)(?:(?P<op>[\^*$]?=)['\"]?(?P<value>[^'\"\]]*)['\"]?)?\]|:(?P<pseudo>[\w-]+)(?:\((?P<arg>[^()]*)\))?")


def attr(name: str) -> Column:
    return F.element_at("attrs", F.lit(name))


def _simple(text: str) -> Column:
    """One compound selector without combinators."""
    found: list[Column] = []
    at = 0
    while at < len(text):
        m = _PART.match(text[at:]) if at else _PART.match(text)
        if not m or not m[0]:
            raise ValueError(f"unsupported selector {text!r}")
        at += len(m[0])
        if m["tag"]:
            if m["tag"] != "*":
                found.append(F.col("tag") == m["tag"].lower())
        elif m["id"]:
            found.append(F.coalesce(attr("id") == m["id"], F.lit(False)))
        elif m["cls"]:
            found.append(F.array_contains("classes", m["cls"]))
        elif m["attr"]:
            name = m["attr"].lower()
            if name.endswith("*"):  # any attribute whose name begins so
                found.append(F.exists(F.map_keys("attrs"), lambda k: k.startswith(name[:-1])))
            elif m["op"] is None:
                found.append(attr(name).isNotNull())
            else:
                test = {"=": lambda a, v: a == v, "^=": lambda a, v: a.startswith(v), "*=": lambda a, v: a.contains(v), "$=": lambda a, v: a.endswith(v)}[m["op"]]
                found.append(F.coalesce(test(attr(name), m["value"]), F.lit(False)))
        elif m["pseudo"] == "not":
            found.append(~css(m["arg"]))
        elif m["pseudo"] == "empty":
            found.append(F.col("n_child_nodes") == 0)
        elif m["pseudo"] == "first-child":
            found.append(F.col("child_index") == 0)
        else:
            raise ValueError(f"unsupported pseudo class {text!r}")
    out = found[0] if found else F.lit(True)
    for c in found[1:]:
        out = out & c
    return out


def css(selector: str) -> Column:
    """A selector list.  Ancestors and parents may be tag names; only the last
    compound is free."""
    out: Column | None = None
    for one in selector.split(","):
        parts = re.findall(r">|[^\s>]+(?:\([^)]*\))?", one.strip())
        own = _simple(parts[-1])
        above = F.slice("path", 1, F.size("path") - 1)
        k = len(parts) - 2
        if k >= 0 and parts[k] == ">":
            own = own & (F.col("parent_tag") == parts[k - 1])
            k -= 2
        while k >= 0:
            own = own & F.array_contains(above, parts[k])
            k -= 1
        out = own if out is None else out | own
    return out
