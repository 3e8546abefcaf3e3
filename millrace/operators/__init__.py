"""Operators: first block, ancestry, lookups, ordered checks, folds, rendering and JSON text."""

from .ancestry import ancestors, nearest_roots
from .blocks import first_block, identity, last_value
from .checks import CHECK, agent_checks, all_passed, fleet, tree_checks, unsourced
from .folds import appended, every, first_by, last_by, some, sorted_join, with_any
from .json_text import json_text, with_json
from .lookup import TopicNotFound, answered, known_paths, lookup, lookup_default, resolve, topic
from .render import checks_text, json_record, sections_text

__all__ = [
    "CHECK", "TopicNotFound", "agent_checks", "all_passed", "ancestors", "answered", "appended", "checks_text", "every", "first_block", "first_by", "fleet", "identity", "json_record",
    "json_text", "known_paths", "last_by", "last_value", "lookup", "lookup_default", "nearest_roots", "resolve", "sections_text", "some", "sorted_join", "topic", "tree_checks", "unsourced", "with_any", "with_json",
]
