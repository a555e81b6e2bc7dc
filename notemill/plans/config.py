"""Settings of a run, kept on the driver: one table of keys, defaults and rules."""

from __future__ import annotations

import copy
import json
import os
import re
from collections.abc import Callable

TEXT, FLAG, TEXTS, MAP, COUNT = "text", "true or false", "a list of texts", "an object", "a whole number"
_IS: dict[str, Callable] = {
    TEXT: lambda v: isinstance(v, str),
    FLAG: lambda v: isinstance(v, bool),
    TEXTS: lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v),
    MAP: lambda v: isinstance(v, dict),
    COUNT: lambda v: isinstance(v, int) and not isinstance(v, bool),
}
# fixed values: the sections and keys of a settings file, with default and what is allowed (a type or the only values)
KEYS = {
    "vault": {"path": ("", TEXT)},
    "input": {"sermon_sources": ([], TEXTS), "file_types": (["docx", "md", "txt", "pdf", "hwpx", "hwp"], TEXTS)},
    "output": {"main_sermon_folder": ("", TEXT), "fragment_folder": ("", TEXT), "log_folder": ("logs", TEXT)},
    "sermon_kinds": {
        "enabled": (False, FLAG),
        "values": ([], TEXTS),
        "marker_to_kind": ({}, MAP),
        "frontmatter_key": ("설교구분", TEXT),
        "folder_by_kind": ({}, MAP),
        "world_by_kind": ({}, MAP),
    },
    "naming": {
        "main_note_pattern": ("{date}_{title}_{main_passage}.md", TEXT),
        "fragment_note_pattern": ("{title}.md", TEXT),
        "date_from_filename": (True, FLAG),
        "target_from_folder": (True, FLAG),
        "collision_policy": ("ask", ["ask", "skip"]),
        "fragment_collision_policy": ("skip", ["ask", "skip", "merge"]),
        "target_markers": ([], TEXTS),
        "folder_to_target": ({}, MAP),
        "folder_number_prefix_strip": (True, FLAG),
    },
    "classification": {
        "use_word": (False, FLAG),
        "world_values": ([], TEXTS),
        "outcome_values": ([], TEXTS),
        "route_values": ([], TEXTS),
        "doctrine_values": ([], TEXTS),
        "allow_unknown_doctrine": (False, FLAG),
        "route_scalar": (False, FLAG),
        "single_world": (False, FLAG),
        "require_value_prefix": ({}, MAP),
        "wrap_values_in_wikilink": (False, FLAG),
        "fragment_world": ("", TEXT),
        "preset": ("", TEXT),
    },
    "bible": {
        "link_style": ("[[{normalized}]]", TEXT),
        "range_policy": ("expand_each_verse", TEXT),
        "max_range_expand": (50, COUNT),
        "note_folder": ("", TEXT),
        "book_aliases": ({}, MAP),
        "frontmatter_key": ("성경구절", TEXT),
    },
    "safety": {
        "dry_run_first": (True, [True]),
        "overwrite_existing": (False, [False]),
        "require_approval_before_write": (True, [True]),
        "preserve_original_files": (True, [True]),
    },
}
DEFAULTS = {"version": 2} | {section: {key: default for key, (default, _) in keys.items()} for section, keys in KEYS.items()}
#: N2, fixed values: searches that each mode may use
SEARCHES = {"research": 12, "enrich": 5, "diagnose": 3}
LINK_FIELDS = {"normalized", "book", "chapter", "verse"}


def merged(given: dict, defaults: dict | None = None) -> dict:
    """The defaults with the given values put over them at every depth; unknown keys stay."""
    base = copy.deepcopy(DEFAULTS if defaults is None else defaults)
    return base | {k: merged(v, base[k]) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in given.items()}


def problems(c: dict) -> list[str]:
    """What is wrong in merged settings: values against the table, then rules between them. Unknown keys are nobody's concern."""
    wrong = []
    for section, keys in KEYS.items():
        if not isinstance(c.get(section), dict):
            wrong.append(f"{section} must be {MAP}")
            continue
        for key, (_, kind) in keys.items():
            value = c[section].get(key)
            if not (_IS[kind](value) if isinstance(kind, str) else any(value is v or value == v and isinstance(v, str) for v in kind)):
                wrong.append(f"{section}.{key} must be " + (kind if isinstance(kind, str) else " or ".join(json.dumps(v) for v in kind)))
    return wrong or _between(c)


def _between(c: dict) -> list[str]:
    """Rules between values that are each well-formed."""
    kinds, style = c["sermon_kinds"], c["bible"]["link_style"]
    declared = {v.strip() for v in kinds["values"]} - {""}
    wrong = ["sermon_kinds.values is empty, but kinds are enabled"] if kinds["enabled"] and not declared else []
    for key, named in (("marker_to_kind", kinds["marker_to_kind"].values()), ("folder_by_kind", kinds["folder_by_kind"]), ("world_by_kind", kinds["world_by_kind"])):
        if odd := sorted({str(k).strip() for k in named} - declared - {""}):
            wrong.append(f"sermon_kinds.{key} names undeclared kinds: {', '.join(odd)}")
    for kind, folder in kinds["folder_by_kind"].items():
        if os.path.isabs(str(folder)) or ".." in re.split(r"[/\\]", str(folder)):
            wrong.append(f"sermon_kinds.folder_by_kind: {kind} must lie in the vault")
    if "{normalized}" not in style:
        wrong.append("bible.link_style must hold {normalized}")
    if odd := sorted(set(re.findall(r"\{([^{}]*)\}", style)) - LINK_FIELDS):
        wrong.append(f"bible.link_style has unknown fields: {', '.join(odd)}")
    return wrong


def load(path: str) -> dict:
    """Settings from a JSON file, merged and checked."""
    with open(path, encoding="utf-8") as f:
        c = merged(json.load(f))
    if wrong := problems(c):
        raise ValueError("; ".join(wrong))
    return c


def read_json(path: str) -> dict:
    """a settings file, empty if it is missing or broken."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def save(c: dict, path: str) -> None:
    """K5: settings to a JSON file, put in place as a whole."""
    if wrong := problems(c):
        raise ValueError("; ".join(wrong))
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(c, f, ensure_ascii=False, indent=2)
    os.replace(f"{path}.new", path)
