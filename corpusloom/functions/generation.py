"""Requests for generated dialogues: prompts, weighted draws, tool lists, and checks of arguments and of JSON replies."""

from __future__ import annotations

import json
import logging
import logging.handlers
import os
import time
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import batched

# The replies of the six kinds of agents, by field; every reply has its type, updates and a short reason.
_TEXT = lambda low, high: {"type": "string", "minLength": low, "maxLength": high}


def _object(fields: dict, optional: tuple[str, ...] = ()) -> dict:
    return {"type": "object", "additionalProperties": False, "required": [k for k in fields if k not in optional], "properties": fields}


def _reply(kind, **fields) -> dict:
    kind = {"const": kind} if isinstance(kind, str) else {"enum": list(kind)}
    return _object({"type": kind, **fields, "blackboard_updates": {"type": "object"}, "why": {"type": "string", "maxLength": 200}})


SCHEMAS = {
    "route": _reply("route", next_agent={"type": "string", "enum": ["retriever", "planner", "operator", "evaluator", "final"]}),
    "action": _reply(("tool_call", "final"), tool={"type": ["string", "null"]}, args={"type": ["object", "null"]}),
    "plan": _reply(
        "plan",
        steps={
            "type": "array",
            "minItems": 1,
            "maxItems": 8,
            "items": _object({"id": _TEXT(1, 32), "intent": _TEXT(1, 120), "done_when": _TEXT(1, 160), "tool_hint": {"type": ["string", "null"], "maxLength": 64}}, ("tool_hint",)),
        },
    ),
    "eval": _reply("eval", decision={"type": "string", "enum": ["advance", "retry", "needs_input", "complete", "fail"]}),
    "retrieval": _reply(
        "retrieval",
        query=_TEXT(1, 200),
        top_k={"type": "integer", "minimum": 1, "maximum": 10},
        chunks={
            "type": "array",
            "minItems": 0,
            "maxItems": 10,
            "items": _object({"id": _TEXT(1, 64), "source": _TEXT(1, 64), "text": _TEXT(1, 800), "score": {"type": ["number", "null"]}, "meta": {"type": ["object", "null"]}}, ("score", "meta")),
        },
    ),
    "summary": _reply("summary", memory=_TEXT(1, 1200), keep={"type": "array", "minItems": 0, "maxItems": 20, "items": _TEXT(1, 128)}, drop_before={"type": ["integer", "null"], "minimum": 0}),
}
# End of fixed values.

_KINDS = {
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "string": lambda x: isinstance(x, str),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer(),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
}


def fault(value, schema: dict, at: str = "") -> str | None:
    """Where a JSON value first breaks a schema, and how; of JSON Schema, the words that ``SCHEMAS`` uses."""
    here = at or "reply"
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_KINDS[k](value) for k in kinds):
        return f"{here}: not of type {'/'.join(kinds)}"
    if "const" in schema and value != schema["const"] or "enum" in schema and value not in schema["enum"]:
        return f"{here}: not an allowed value"
    for low, high, size in (("minLength", "maxLength", len(value) if isinstance(value, str) else None), ("minItems", "maxItems", len(value) if isinstance(value, list) else None), ("minimum", "maximum", value if _KINDS["number"](value) else None)):
        if size is not None and not schema.get(low, size) <= size <= schema.get(high, size):
            return f"{here}: out of range"
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                return f"{name if not at else f'{at}.{name}'}: missing"
        for name, inner in fields.items():
            if name in value and (found := fault(value[name], inner, f"{at}.{name}".lstrip("."))):
                return found
        if schema.get("additionalProperties") is False and (extra := [k for k in value if k not in fields]):
            return f"{f'{at}.{extra[0]}'.lstrip('.')}: not expected"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if found := fault(x, schema["items"], f"{at}[{i}]"):
                return found
    return None


def schema_problem(text: Column, schema: dict) -> Column:
    """Where a JSON text breaks a schema, and how; null where it does not."""

    @batched("string")
    def check(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(fault(json.loads(t or ""), schema))
            except ValueError:
                out.append("reply: not JSON")
        return pd.Series(out, dtype="object")

    return check(text)


@batched("string")
def pretty(text: pd.Series) -> pd.Series:
    """JSON with sorted keys and an indent of two."""
    return text.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=False, indent=2, sort_keys=True))


def prompt(category: Column, language: Column, n: Column, depth: Column) -> Column:
    """The request for n dialogues of a category, language and number of messages."""
    between = F.when(category.isin("local_context", "correction"), F.when(depth == 4, "; nothing unrelated between").when(depth == 6, "; one unrelated exchange between").otherwise("; two unrelated exchanges between")).otherwise("")
    named = F.when(language == "en", "English").otherwise("Brazilian Portuguese")
    return F.format_string("Category: %s. Messages: %d. Language: %s. Exactly %d examples, each unlike the others%s.", category, depth, named, n, between)


def weighted(digest: Column, weights: dict[str, float]) -> Column:
    """A name drawn by weights from a hexadecimal hash; negative weights count as none, and no weight at all raises."""
    kept = [(k, max(0.0, float(w))) for k, w in weights.items()]
    total = sum(w for _, w in kept)
    if total <= 0:
        raise ValueError("all weights are zero")
    point = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32) * total
    out = F.lit(None).cast("string")
    for (name, w), high in reversed(list(zip(kept, accumulate(w for _, w in kept), strict=True))):
        out = F.when(point < high, F.lit(name)).otherwise(out) if w else out
    return out


def tools_block(tools: Column) -> Column:
    """A line for each tool with the names of its arguments. tools: array of name, args."""
    line = lambda t: F.concat(F.lit("- "), t["name"], F.when(F.size(t["args"]) > 0, F.concat(F.lit("("), F.array_join(t["args"], ", "), F.lit(")"))).otherwise(""))
    return F.array_join(F.concat(F.array(F.lit("AVAILABLE TOOLS:")), F.transform(tools, line)), "\n")


def check_arguments(categories, languages, batch_id: str, batch_size: int, acceptance: float, safety: float, max_tokens: int, known_categories, known_languages=("en", "pt")) -> None:
    """Raise for the first argument of a generation run that is out of its range."""
    for what, given, known in (("categories", categories, known_categories), ("languages", languages, known_languages)):
        if lost := sorted(set(given) - set(known)):
            raise ValueError(f"unknown {what}: {lost}")
    rules = [
        (len(batch_id) == 4 and batch_id.isdigit(), "the batch id has four digits"),
        (batch_size > 0, "the batch size is above zero"),
        (0 < acceptance <= 1, "the acceptance rate is above 0 and at most 1"),
        (safety >= 1, "the safety factor is at least 1"),
        (max_tokens > 0, "the most tokens are above zero"),
    ]
    for holds, rule in rules:
        if not holds:
            raise ValueError(rule)


class _Lines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        spelled = {"time": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(record.created)), "level": record.levelname, "pipeline": record.name, "message": record.getMessage()}
        if record.exc_info:
            spelled["error"] = self.formatException(record.exc_info)
        return json.dumps(spelled, ensure_ascii=False)


def logger(pipeline: str, folder: str, level: str = "INFO", to_stdout: bool = False, most_bytes: int = 100_000_000) -> logging.Logger:
    """The driver's log of a pipeline: JSON lines in a file of its own that is rotated when it is full."""
    os.makedirs(folder, exist_ok=True)
    log = logging.getLogger(pipeline)
    log.setLevel(level)
    log.propagate = False
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    handlers: list[logging.Handler] = [logging.handlers.RotatingFileHandler(f"{folder}/{pipeline}.jsonl", maxBytes=most_bytes, backupCount=10, encoding="utf-8")]
    if to_stdout:
        handlers.append(logging.StreamHandler())
    for h in handlers:
        h.setFormatter(_Lines())
        log.addHandler(h)
    return log
