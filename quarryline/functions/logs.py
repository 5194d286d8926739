"""Training-log lines as typed events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line formats a training log is made of.
STEP = r"^step\s+(\d+)/(\d+)"
VALIDATION = r"Step\s+(\d+)\s+\|\s+Validation bpb:\s+([0-9.]+)"
CORE = r"Step\s+(\d+)\s+\|\s+CORE metric:\s+([0-9.]+)"
CDPK = r"Step\s+(\d+)\s+\|\s+CDPK accuracy:\s+([0-9.]+)\s+\((\d+)/(\d+)\)"
ITERATIONS_AUTO = r"Calculated number of iterations from target data:param ratio:\s*([0-9,]+)"
ITERATIONS_FIXED = r"Using user-provided number of iterations:\s*([0-9,]+)"
TRAINING_TOKENS = r"Total number of training tokens:\s*([0-9,]+)"
BATCH_AUTO = r"Auto-computed optimal batch size:\s*([0-9,]+)\s+tokens"
BATCH_TOTAL = r"Total batch size\s*([0-9,]+)\s*=>"
TASK = (
    r"Evaluating:\s+(\S+)\s+\((\d+)-shot,\s+type:\s+(\w+)\)\.\.\.\s+"
    r"accuracy:\s+([0-9.-]+)\s+\|\s+centered:\s+([0-9.-]+)"
)

# Field of the event -> type; a line fills the fields its format has.
FIELDS = {
    "step": "bigint",
    "value": "double",
    "n": "bigint",
    "d": "bigint",
    "task": "string",
    "shots": "bigint",
    "type": "string",
    "accuracy": "double",
    "centered": "double",
}

# Kind of event -> (format, a literal part to look for first, fields in group order).
FORMATS = {
    "step": (STEP, "step", ("step", "n")),
    "val": (VALIDATION, "Validation bpb:", ("step", "value")),
    "core": (CORE, "CORE metric:", ("step", "value")),
    "cdpk": (CDPK, "CDPK accuracy:", ("step", "value", "n", "d")),
    "iterations_auto": (ITERATIONS_AUTO, "target data:param ratio:", ("n",)),
    "iterations_fixed": (ITERATIONS_FIXED, "user-provided number", ("n",)),
    "tokens": (TRAINING_TOKENS, "training tokens:", ("n",)),
    "batch_auto": (BATCH_AUTO, "optimal batch size:", ("n",)),
    "batch_total": (BATCH_TOTAL, "Total batch size", ("n",)),
    "task": (TASK, "Evaluating:", ("task", "shots", "type", "accuracy", "centered")),
}


def line_events(line: Column) -> Column:
    """What a line reports, as an array of (kind, groups) structs: usually none or one."""
    found = []
    for kind, (pattern, part, fields) in FORMATS.items():
        groups = F.array(*[F.regexp_extract(line, pattern, i + 1) for i in range(len(fields))])
        event = F.struct(F.lit(kind).alias("kind"), groups.alias("groups"))
        found.append(F.when(line.contains(part) & line.rlike(pattern), event))
    return F.array_compact(F.array(*found))


def event_fields(kind: Column, groups: Column) -> list[Column]:
    """The typed fields of an event, null where its format has no such field."""
    columns = []
    for name, dtype in FIELDS.items():
        places: dict[int, list[str]] = {}
        for of_kind, (_, _, fields) in FORMATS.items():
            if name in fields:
                places.setdefault(fields.index(name), []).append(of_kind)
        text = F.coalesce(*[F.when(kind.isin(kinds), groups[place]) for place, kinds in places.items()])
        if dtype == "bigint":
            text = F.replace(text, F.lit(","), F.lit(""))
        columns.append((text if dtype == "string" else text.try_cast(dtype)).alias(name))
    return columns
