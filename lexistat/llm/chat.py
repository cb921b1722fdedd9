"""Chat formatting by schema fingerprints.

A record is a JSON object. Its nested field paths (list items as []), cut down to the names that any layout
knows, are sorted and hashed; the hash selects a declarative mapping that turns prompt, instruction or message
layouts into canonical turns (role, text). A layout may name further paths that a record can have or not, texts of a
list may be strings or lists of parts, and names of other layouts beside a whole layout change nothing: of the
layouts that a record meets, the first in the table reads it. A template then marks the turns, escapes control strings inside
roles and texts so that they can be read back, and gives the spans of the assistant's texts as loss mask.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistat.llm.frames import col, free_name

# What some sources call the roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
# A layout lists its paths, those it may have too, and where turns come from: ("each", list, role field, text field)
# or (role, field, more fields of the same text). The first layout that a record meets reads it.
LAYOUTS: dict[str, dict[str, Any]] = {
    "messages": {"paths": ["messages[].role", "messages[].content"], "also": ["system"],
                 "turns": [("system", "system"), ("each", "messages", "role", "content")]},
    "turns": {"paths": ["turns[].role", "turns[].text"], "also": ["system"],
              "turns": [("system", "system"), ("each", "turns", "role", "text")]},
    "from_value": {"paths": ["conversations[].from", "conversations[].value"], "also": ["system"], "roles": ROLES,
                   "turns": [("system", "system"), ("each", "conversations", "from", "value")]},
    "instruction_input": {"paths": ["instruction", "input", "output"], "also": ["system"],
                          "turns": [("system", "system"), ("user", "instruction", "input"), ("assistant", "output")]},
    "instruction": {"paths": ["instruction", "output"], "also": ["system"],
                    "turns": [("system", "system"), ("user", "instruction"), ("assistant", "output")]},
    "prompt_completion": {"paths": ["prompt", "completion"], "also": ["system"],
                          "turns": [("system", "system"), ("user", "prompt"), ("assistant", "completion")]},
    "system_prompt_response": {"paths": ["system", "prompt", "response"],
                               "turns": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    "prompt_response": {"paths": ["prompt", "response"], "turns": [("user", "prompt"), ("assistant", "response")]},
    "question_answer": {"paths": ["question", "answer"], "also": ["system"],
                        "turns": [("system", "system"), ("user", "question"), ("assistant", "answer")]},
    "nested_data": {"paths": ["data.prompt", "data.response"], "also": ["data.system"],
                    "turns": [("system", "data.system"), ("user", "data.prompt"), ("assistant", "data.response")]},
}
# Control strings of common chat templates; the first two are those of the template below.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
CHAT_TYPE = pa.struct([("layout", pa.string()), ("formatted", pa.string()),
                       ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
BACK_TYPE = pa.struct([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string())])


def field_paths(value: Any, path: str = "") -> set[str]:
    """The paths of all leaves; an empty object is a leaf itself, and an empty list one marked [none]."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{path}.{k}" if path else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, f"{path}[]") for v in value))
    return {f"{path}[none]" if value == [] else path}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def subsets(paths: Iterable[str]) -> list[set[str]]:
    paths = list(paths)
    return [set(c) for n in range(len(paths) + 1) for c in itertools.combinations(paths, n)]


def met_paths(layout: dict[str, Any]) -> list[set[str]]:
    """Every set of paths that the layout reads."""
    forms = [set(layout["paths"])]
    for kind, *rest in layout["turns"]:
        if kind == "each":  # texts may be strings, lists of strings or lists of objects with a text; or no item at all
            role, text = (f"{rest[0]}[].{name}" for name in rest[1:])
            forms = [{role} | some for some in subsets([text, f"{text}[]", f"{text}[].text", f"{text}[none]"]) if some]
            forms.append({f"{rest[0]}[none]"})
    return [form | some for form in forms for some in subsets(layout.get("also", []))]


OWN_PATHS = {name: set().union(*met_paths(layout)) for name, layout in LAYOUTS.items()}
KNOWN_PATHS = set().union(*OWN_PATHS.values())
MET = {name: {fingerprint(paths) for paths in met_paths(layout)} for name, layout in LAYOUTS.items()}


@functools.lru_cache(4096)
def layout_of(known: frozenset[str]) -> str | None:
    """The first layout with the fingerprint of its own paths in a record."""
    return next((name for name, own in OWN_PATHS.items() if fingerprint(known & own) in MET[name]), None)


def field(record: Any, path: str) -> Any:
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def plain(value: Any) -> str:
    """Null as empty text, a string as it is, anything else as JSON."""
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def said(value: Any) -> str:
    """The text of a turn: that of its parts, one in a line, if it is a list; parts without text say nothing."""
    if not isinstance(value, list):
        return plain(value)
    texts = [part.get("text") if isinstance(part, dict) else part for part in value]
    return "\n".join(plain(t) for t in texts if t is not None)


def canonical(raw: str | None) -> dict[str, Any] | None:
    """The layout and turns of a JSON record; None for an unknown layout or for text that is no JSON object."""
    try:
        record = json.loads(raw or "")
    except ValueError:
        return None
    paths = frozenset(field_paths(record) & KNOWN_PATHS) if isinstance(record, dict) else frozenset()
    name = layout_of(paths)
    if name is None:
        return None
    turns, roles = [], LAYOUTS[name].get("roles", {})
    for first, *rest in LAYOUTS[name]["turns"]:
        if first == "each":
            for item in field(record, rest[0]):
                item = item if isinstance(item, dict) else {}
                role = plain(item.get(rest[1]))
                turns.append({"role": roles.get(role, role), "text": said(item.get(rest[2]))})
        elif rest[0] in paths:
            parts = [plain(field(record, path)) for path in rest]
            turns.append({"role": first, "text": "\n\n".join([parts[0], *filter(None, parts[1:])])})
    return {"layout": name, "turns": turns}


def escape(text: str) -> str:
    """Backslashes are doubled; a control string gets one backslash after its first character."""
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.?)", lambda m: "\\" if m[1] == "\\" else m[1], text, flags=re.S)


def template(turns: list[dict[str, str]]) -> dict[str, Any]:
    """<s>role, line feed, text</s>, line feed for each turn; and the spans of the assistant's texts."""
    parts, spans, at = [], [], 0
    for turn in turns:
        head = f"<s>{escape(turn['role'] or '').replace(chr(10), chr(92) + chr(10))}\n"
        text = escape(turn["text"] or "")
        if turn["role"] == "assistant":
            spans.append({"start": at + len(head), "end": at + len(head) + len(text)})
        parts.append(f"{head}{text}</s>\n")
        at += len(parts[-1])
    return {"formatted": "".join(parts), "loss": spans}


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from the formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        cut = at + 3
        while formatted[cut] != "\n":
            cut += 2 if formatted[cut] == "\\" else 1
        end = formatted.index("</s>\n", cut)
        turns.append((unescape(formatted[at + 3 : cut]), unescape(formatted[cut + 1 : end])))
        at = end + 5
    return turns


def digest(formatted: str | None, loss: list[dict[str, int]] | None) -> dict[str, Any] | None:
    if formatted is None:
        return None
    turns = parse(formatted)
    said = "".join(unescape(formatted[s["start"] : s["end"]]) for s in loss or [])
    return {
        "n_turns": len(turns),
        "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
        "loss_chars": len(said), "loss_sha256": hashlib.sha256(said.encode()).hexdigest(),
    }


CHAT = "struct<layout string, formatted string, loss array<struct<start bigint, end bigint>>>"
BACK = "struct<n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string>"


def formatted_record(raw: str | None) -> dict[str, Any] | None:
    found = canonical(raw)
    return None if found is None else {"layout": found["layout"], **template(found["turns"])}


def formatted_records(records: pa.Array) -> pa.Array:
    return pa.array((formatted_record(r.as_py()) for r in records), CHAT_TYPE, size=len(records))


def read_back(formatted: pa.Array) -> pa.Array:
    rows = (x.as_py() for x in formatted)  # one at a time: texts may be long
    return pa.array((None if x is None else digest(x["formatted"], x["loss"]) for x in rows), BACK_TYPE, size=len(formatted))


def format_records(records: DataFrame, record: str = "record") -> tuple[DataFrame, str]:
    """The rows with one more column, a struct of layout, formatted text and loss spans; and that column's name.

    The struct is null for a null record, text that is no JSON object, or an unknown layout (`layout_counts` tells how
    many there are); a record with an empty list of turns gives an empty text. Fields that no layout knows are ignored,
    so extra fields never clash.
    """
    out = free_name(records, "chat")
    return records.withColumn(out, F.arrow_udf(formatted_records, CHAT)(col(record))), out


def conversation_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record) from rows (conv_id, turn, role, text): a conversation as one JSON object with its turns
    in order of turn, then role, then text. Null turns come first, a null role or text is empty. A formatted
    conversation is one value, so its rows have to meet in one place whatever their number.

    A third of the conversations each (by a hash of conv_id) are written as turns, as messages, and as messages with
    lists of parts, so that fingerprints tell layouts apart."""
    part = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = F.sort_array(F.collect_list(part))
    turns = F.transform(said, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    messages = F.transform(said, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    parts = F.transform(said, lambda t: F.struct(t["role"].alias("role"), F.array(
        F.struct(F.lit("text").alias("type"), t["text"].alias("text"))).alias("content")))
    kind = F.pmod(F.hash("conv_id"), F.lit(3))
    return rows.groupBy("conv_id").agg(
        F.when(kind == 0, F.to_json(F.struct(turns.alias("turns"))))
        .when(kind == 1, F.to_json(F.struct(messages.alias("messages"))))
        .otherwise(F.to_json(F.struct(parts.alias("messages")))).alias("record")
    )


def layout_counts(made: DataFrame, chat: str) -> DataFrame:
    """layout, n: the records read by each layout; a null layout counts those that none could read."""
    return made.groupBy(col(chat)["layout"].alias("layout")).agg(F.count(F.lit(1)).alias("n"))


def conversation_digests(rows: DataFrame) -> DataFrame:
    """Counts and digests of every conversation, read back from its formatted text."""
    made, chat = format_records(conversation_records(rows), "record")
    back = made.withColumn("_back", F.arrow_udf(read_back, BACK)(
        F.struct(col(chat)["formatted"].alias("formatted"), col(chat)["loss"].alias("loss"))))
    return back.select("conv_id", "_back.*", F.length(col(chat)["formatted"]).cast("bigint").alias("formatted_chars"))
