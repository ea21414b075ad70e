"""The fold of mixed event logs: every operation, on every type, at any path.

Closed forms (resolve, crdt, sequence) need a log of one kind of operation. Where replacements, deletions,
sync flags, merges and typed operations meet in one row, and address cells inside of it, the result
depends on arrival, and only a fold by key is faithful. Events go to tasks by key and are sorted by
arrival there; a task holds the state of one row at a time, never its events.

Events: pk, offset, path (array of steps "Record:name" or "List:id", null or empty for the row), op (replace,
delete, set_sync, merge, type), tag, arg (JSON: the value, the cell to merge, or the typed operation),
sync, H, dev. A cell is a dict of tag (null: tombstone), value, h and sync; its JSON is what is stored.

Rules that decide, for all types alike: a cell changes only by a clock strictly newer than its own; a
typed operation or a step into a container first needs that type there, which a cell of another type (a
tombstone, too) takes on, empty, if the clock is newer than everything in it. A replacement inside a
row needs its value's type the same way, so one that heals a cell leaves it empty. Changes inside
do not move the clocks above. Operations that a type refuses change nothing but containers
made on the way, and are reported (dead letters).
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.functions.workers import reachable

ZERO = ""
MOST = (1 << 64) - 1


class Refused(ValueError):
    """An operation that its type does not allow."""


def dummy(tag: str | None = None) -> dict:
    return {"tag": tag, "value": KINDS[tag].empty() if tag else None, "h": ZERO, "sync": None}


def later(d: dict, key: str, h: str) -> bool:
    """Keeps the newest clock under a key."""
    if h > (d.get(key) or ZERO):
        d[key] = h
        return True
    return False


class Scalar:
    """Replaced as a whole; of two replicas' values the newer cell's counts."""

    def __init__(self, zero: object):
        self.zero = zero

    def empty(self) -> object:
        return copy.copy(self.zero)

    def act(self, value, arg: dict, h: str) -> bool:
        raise Refused("no typed operations")

    def join(self, cell: dict, other: dict) -> bool:
        if other["h"] > cell["h"]:
            cell["value"] = other["value"]
            return True
        return False

    def trim(self, value, watermark: str) -> None: ...

    def newest(self, value) -> str:
        return ZERO


class Counter(Scalar):
    """Increments and decrements of each device."""

    def act(self, value, arg, h):
        device, n = h[-16:], arg["n"] if arg["do"] == "increment" else -arg["n"]
        own = value.setdefault(device, [0, 0])
        side = 0 if n > 0 or (n == 0 and arg["do"] == "increment") else 1
        if own[side] + abs(n) > MOST:
            raise Refused("counter overflow")
        own[side] += abs(n)
        return True

    def join(self, cell, other):
        before = copy.deepcopy(cell["value"])
        for device, (p, n) in other["value"].items():
            own = cell["value"].setdefault(device, [0, 0])
            own[:] = [max(own[0], p), max(own[1], n)]
        return cell["value"] != before


class Set(Scalar):
    """Of each element the newest addition and the newest removal."""

    def act(self, value, arg, h):
        return later(value.setdefault(arg["elem"], {}), "updated" if arg["do"] == "add" else "deleted", h)

    def join(self, cell, other):
        changed = False
        for elem, theirs in other["value"].items():
            changed |= elem not in cell["value"]
            own = cell["value"].setdefault(elem, {})
            for side, h in theirs.items():
                changed |= later(own, side, h)
        return changed

    def trim(self, value, watermark):
        for elem in [e for e, x in value.items() if (x.get("deleted") or ZERO) >= (x.get("updated") or ZERO) and (x.get("deleted") or ZERO) <= watermark]:
            del value[elem]

    def newest(self, value):
        return max((h for x in value.values() for h in x.values()), default=ZERO)


class OrSet(Scalar):
    """Of each element the tags that added it, and the tags that removals have seen."""

    def act(self, value, arg, h):
        own = value.setdefault(arg["elem"], {"adds": {}, "gone": {}})
        if arg["do"] == "add":
            new = h not in own["adds"]
            own["adds"][h] = True
            return new
        return any([later(own["gone"], tag, h) for tag in arg["observed"]])

    def join(self, cell, other):
        changed = False
        for elem, theirs in other["value"].items():
            changed |= elem not in cell["value"]
            own = cell["value"].setdefault(elem, {"adds": {}, "gone": {}})
            changed |= not theirs["adds"].keys() <= own["adds"].keys()
            own["adds"].update(theirs["adds"])
            changed |= any([later(own["gone"], t, h) for t, h in theirs["gone"].items()])
        return changed

    def trim(self, value, watermark):
        for elem, x in list(value.items()):
            for tag in [t for t in x["adds"] if t <= watermark and t in x["gone"] and x["gone"][t] <= watermark]:
                del x["adds"][tag], x["gone"][tag]
            if not x["adds"] and not x["gone"]:
                del value[elem]

    def newest(self, value):
        return max((h for x in value.values() for h in [*x["adds"], *x["gone"], *x["gone"].values()]), default=ZERO)


class Register(Scalar):
    """Concurrent values by assignment, and the assignments that later ones replaced."""

    def act(self, value, arg, h):
        if h in value["own"] and value["own"][h] != arg["value"]:
            raise Refused(f"assignment {h} has another value")
        changed = any([later(value["gone"], i, h) for i in arg.get("replaces", ())])
        changed |= any([value["own"].pop(i, value) is not value for i in arg.get("replaces", ())])
        if h not in value["gone"] and h not in value["own"]:
            value["own"][h] = arg["value"]
            changed = True
        return changed

    def join(self, cell, other):
        own, theirs = cell["value"], other["value"]
        for i, v in theirs["own"].items():
            if i in own["own"] and own["own"][i] != v:
                raise Refused(f"assignment {i} has another value")
        changed = any([later(own["gone"], i, h) for i, h in theirs["gone"].items()])
        for i, v in theirs["own"].items():
            if i not in own["gone"] and i not in own["own"]:
                own["own"][i], changed = v, True
        for i in [i for i in own["own"] if i in own["gone"]]:
            del own["own"][i]
            changed = True
        return changed

    def trim(self, value, watermark):
        for i in [i for i, h in value["gone"].items() if i <= watermark and h <= watermark]:
            del value["gone"][i]

    def newest(self, value):
        return max([*value["own"], *value["gone"], *value["gone"].values()], default=ZERO)


class Queue(Scalar):
    """Entries by push, and the newest pop of each, which may come first."""

    def act(self, value, arg, h):
        if arg["do"] == "pop":
            return h > arg["id"] and later(value["out"], arg["id"], h)
        entry = [arg["priority"], arg.get("value")]
        if h in value["in"] and value["in"][h] != entry:
            raise Refused(f"push {h} has another value")
        new = h not in value["in"]
        value["in"][h] = entry
        return new

    def join(self, cell, other):
        own, theirs = cell["value"], other["value"]
        if any(own["in"].get(i, x) != x for i, x in theirs["in"].items()):
            raise Refused("a push has another value")
        changed = any([later(own["out"], i, h) for i, h in theirs["out"].items()]) | any(i not in own["in"] for i in theirs["in"])
        own["in"].update(theirs["in"])
        return changed

    def trim(self, value, watermark):
        for i in [i for i, h in value["out"].items() if h <= watermark]:
            del value["out"][i]
            value["in"].pop(i, None)

    def newest(self, value):
        return max([*value["in"], *value["out"].values()], default=ZERO)


class Record(Scalar):
    """Cells by name."""

    def child(self, value, name: str, tag: str | None) -> dict:
        return value.setdefault(name, dummy(tag))

    def has(self, value, name: str) -> dict | None:
        return value.get(name)

    def join(self, cell, other):
        changed = False
        for name, theirs in other["value"].items():
            if name in cell["value"]:
                changed |= merge(cell["value"][name], theirs)
            else:
                cell["value"][name], changed = copy.deepcopy(theirs), True
        return changed

    def trim(self, value, watermark):
        for name in [n for n, c in value.items() if c["tag"] is None and c["h"] <= watermark]:
            del value[name]
        for c in value.values():
            compact(c, watermark)

    def newest(self, value):
        return max(map(newest, value.values()), default=ZERO)


def bare(entries: dict, dead: Callable[[dict], bool]) -> None:
    """Takes entries away that are dead and that none of the rest stands after, until none is left."""
    held: dict = {}
    for x in entries.values():
        held[x["after"]] = held.get(x["after"], 0) + 1
    todo = [i for i, x in entries.items() if dead(x) and not held.get(i)]
    while todo:
        after = entries.pop(todo.pop())["after"]
        if after is not None:
            held[after] -= 1
            if not held[after] and after in entries and dead(entries[after]):
                todo.append(after)


class List(Scalar):
    """Cells by id, each after another; what is known of an element before its insertion waits for it."""

    def act(self, value, arg, h):
        gone = arg["do"] == "delete"
        i = arg["id"] if gone else h
        if not i:
            raise Refused("no id")
        fresh = {"tag": None if gone else arg["tag"], "value": None if gone else arg["value"], "h": h, "sync": None}
        if i not in value:
            value[i] = {"after": None if gone else arg.get("after"), "known": not gone, "cell": fresh}
            return True
        placed = not gone and self.place(value[i], arg.get("after"))
        return merge(value[i]["cell"], fresh) or placed

    @staticmethod
    def place(entry: dict, after: str | None) -> bool:
        if entry["known"]:
            if entry["after"] != after:
                raise Refused("an element has two places")
            return False
        entry["after"], entry["known"] = after, True
        return True

    def child(self, value, i: str, tag: str | None) -> dict:
        if not i:
            raise Refused("no id")
        return value.setdefault(i, {"after": None, "known": False, "cell": dummy(tag)})["cell"]

    def has(self, value, i: str) -> dict | None:
        return value[i]["cell"] if i in value else None

    def join(self, cell, other):
        own, changed = cell["value"], False
        for i, theirs in other["value"].items():
            if i in own:
                changed |= theirs["known"] and self.place(own[i], theirs["after"])
                changed |= merge(own[i]["cell"], theirs["cell"])
            else:
                own[i], changed = copy.deepcopy(theirs), True
        return changed

    def trim(self, value, watermark):
        for x in value.values():
            compact(x["cell"], watermark)
        bare(value, lambda x: x["cell"]["tag"] is None and x["cell"]["h"] <= watermark)

    def newest(self, value):
        return max((newest(x["cell"]) for x in value.values()), default=ZERO)


class Text(Scalar):
    """Characters by id (clock and eight hex digits), each after another, with deletions and attributes."""

    @staticmethod
    def entry(value, i: str) -> dict:
        if not i.strip("0"):
            raise Refused("no id")
        return value.setdefault(i, {"after": None, "known": False, "ch": None, "gone": None, "attrs": {}})

    def act(self, value, arg, h):
        changed = False
        if arg["do"] == "insert":
            after = arg.get("after")
            for n, ch in enumerate(arg["text"]):
                i = f"{h}{n:08x}"
                if (old := value.get(i)) and old["known"] and (old["after"], old["ch"]) != (after, ch):
                    raise Refused(f"character {i} is another")
                x = self.entry(value, i)
                changed |= not x["known"]
                x.update(after=after, known=True, ch=ch)
                after = i
            return changed
        for i in arg["ids"]:
            new = i not in value
            x = self.entry(value, i)
            if arg["do"] == "delete":
                changed |= later(x, "gone", h)
            else:
                old = x["attrs"].get(arg["key"])
                if old is None or h > old[1]:
                    x["attrs"][arg["key"]] = [arg.get("value"), h]
                    changed = True
            changed |= new
        return changed

    def join(self, cell, other):
        own, changed = cell["value"], False
        for i, x in other["value"].items():
            if i in own and own[i]["known"] and x["known"] and (own[i]["after"], own[i]["ch"]) != (x["after"], x["ch"]):
                raise Refused(f"character {i} is another")
        for i, x in other["value"].items():
            if i not in own:
                own[i], changed = copy.deepcopy(x), True
                continue
            if x["known"] and not own[i]["known"]:
                own[i].update(after=x["after"], known=True, ch=x["ch"])
                changed = True
            changed |= bool(x["gone"]) and later(own[i], "gone", x["gone"])
            for key, (v, h) in x["attrs"].items():
                old = own[i]["attrs"].get(key)
                if old is None or h > old[1]:
                    own[i]["attrs"][key], changed = [v, h], True
        return changed

    def trim(self, value, watermark):
        bare(value, lambda x: bool(x["gone"]) and x["gone"] <= watermark)
        for x in value.values():
            x["attrs"] = {k: v for k, v in x["attrs"].items() if v[0] is not None or v[1] > watermark}

    def newest(self, value):
        return max((max([i[:-8], x["gone"] or ZERO, *(h for _, h in x["attrs"].values())]) for i, x in value.items()), default=ZERO)


KINDS: dict[str, Scalar] = {
    "Bool": Scalar(False), "Int": Scalar(0), "String": Scalar(""), "Timestamp": Scalar(0), "Blob": Scalar(""), "Counter": Counter({}), "Set": Set({}), "OrSet": OrSet({}),
    "Record": Record({}), "List": List({}), "Text": Text({}),
}


def _twofold(kind: type[Scalar], a: str, b: str) -> Scalar:
    own = kind(None)
    own.empty = lambda: {a: {}, b: {}}
    return own


KINDS |= {"MvRegister": _twofold(Register, "own", "gone"), "PriorityQueue": _twofold(Queue, "in", "out")}


def newest(cell: dict) -> str:
    """The newest clock of a cell and of all in it."""
    return max(cell["h"], KINDS[cell["tag"]].newest(cell["value"])) if cell["tag"] else cell["h"]


def compact(cell: dict, watermark: str) -> dict:
    """The cell without what every replica knows to be dead, at any depth."""
    if cell["tag"]:
        KINDS[cell["tag"]].trim(cell["value"], watermark)
    return cell


def heal(cell: dict, tag: str, h: str) -> bool:
    """Whether the cell has the type, which it takes on for a clock newer than all of it."""
    if cell["tag"] == tag:
        return True
    if h <= newest(cell):
        return False
    cell.update(tag=tag, value=KINDS[tag].empty(), h=h)
    return True


def merge(cell: dict, other: dict) -> bool:
    """Another replica's cell: of two types (or one tombstone) the newer, of one type both, at any depth. The
    cell keeps its own sync flag."""
    if cell["tag"] and cell["tag"] == other["tag"]:
        changed = KINDS[cell["tag"]].join(cell, other)
    elif other["h"] > cell["h"]:
        cell.update(tag=other["tag"], value=copy.deepcopy(other["value"]))
        changed = True
    else:
        changed = False
    return later(cell, "h", other["h"]) or changed


def act(cell: dict, event: dict) -> bool:
    """An operation on this very cell."""
    op, h = event["op"], event["H"]
    if op == "type":
        if not heal(cell, event["tag"], h):
            return False
        changed = KINDS[cell["tag"]].act(cell["value"], event["arg"], h)
        if changed:
            later(cell, "h", h)
        return changed
    if op == "merge":
        return merge(cell, event["arg"])
    if h <= cell["h"]:
        return False
    if op == "set_sync":
        cell.update(sync=event["sync"], h=h)
    elif op == "delete":
        cell.update(tag=None, value=None, h=h)
    elif op == "replace":
        cell.update(tag=event["tag"], value=copy.deepcopy(event["arg"]), h=h)
    else:
        raise Refused(f"no operation {op}")
    return True


def target(event: dict) -> str | None:
    """The type that an operation needs or brings."""
    return {"type": event["tag"], "replace": event["tag"], "merge": (event["arg"] or {}).get("tag") if event["op"] == "merge" else None}.get(event["op"])


def walk(cell: dict, event: dict, path: list[tuple[str, str]]) -> bool:
    """An operation on the cell at a path; containers on the way are made where they are missing."""
    for n, (tag, name) in enumerate(path):
        if not heal(cell, tag, event["H"]):
            return False
        wants = path[n + 1][0] if n + 1 < len(path) else target(event)
        cell = KINDS[tag].child(cell["value"], name, wants)
        if wants and not heal(cell, wants, event["H"]):
            return False
    return act(cell, event)


def synced(cell: dict, path: list[tuple[str, str]], inherited: bool) -> bool:
    """The nearest sync flag on a path, the target's own included."""
    for step in [*path, None]:
        inherited = inherited if cell["sync"] is None else cell["sync"]
        if step is None or cell["tag"] != step[0]:
            break
        cell = KINDS[step[0]].has(cell["value"], step[1])
        if cell is None:
            break
    return inherited


def apply(cell: dict, event: dict, sync: bool = True, device: str | None = None) -> bool:
    """One event on a row's cell. Events of other devices need a synced target, but for set_sync."""
    path = [tuple(step.split(":", 1)) for step in event["path"] or ()]
    if any(len(step) != 2 or step[0] not in ("Record", "List") for step in path):
        raise Refused("no such step")
    if device is not None and event["op"] != "set_sync" and event["dev"] != device and not synced(cell, path, sync):
        return False
    if event["op"] in ("replace", "type") and event["tag"] not in KINDS:
        raise Refused(f"no type {event['tag']}")
    return walk(cell, event, path)


SHAPE = "offset long, error string, tag string, value string, H string, newest string, sync boolean, applied long"


def fold(events: DataFrame, sync: bool = True, device: str | None = None, before: DataFrame | None = None, watermark: str | None = None) -> DataFrame:
    """One row for each key (offset and error null): tag, value (JSON), H, newest clock, sync and how many
    events changed it; and one row for each refused event (offset and error).

    before: states of an earlier fold, from which this one goes on. watermark: compacts the states.
    """
    kind = events.schema["pk"].dataType
    cols = ["pk", "offset", "path", "op", "tag", "arg", "sync", "H", "dev"]
    own = events.select(*(F.col(c) if c in events.columns else F.lit(None).cast({"path": "array<string>", "sync": "boolean"}.get(c, "string")).alias(c) for c in cols))
    if before is not None:
        state = F.to_json(F.struct("tag", "value", F.col("H").alias("h"), "sync"), {"ignoreNullFields": "false"})
        none = F.lit(None)
        own = own.unionByName(before.filter("error is null").select(
            "pk", F.lit(-1).cast("long").alias("offset"), none.cast("array<string>").alias("path"), F.lit("state").alias("op"), none.cast("string").alias("tag"), state.alias("arg"),
            none.cast("boolean").alias("sync"), none.cast("string").alias("H"), none.cast("string").alias("dev"),
        ))
    names = ["pk", "offset", "error", "tag", "value", "H", "newest", "sync", "applied"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell, applied, out = None, None, 0, []

        def told(a: list) -> pa.RecordBatch:
            types = [schema.field(n).type for n in names]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in a], t) for i, t in enumerate(types)], names)

        def end() -> None:
            if cell is not None:
                if watermark is not None:
                    compact(cell, watermark)
                value = None if cell["tag"] is None else json.dumps(cell["value"], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
                out.append((key, None, None, cell["tag"], value, cell["h"], newest(cell), cell["sync"], applied))

        schema = None
        for b in batches:
            if schema is None:
                schema = pa.schema([("pk", b.schema.field("pk").type), ("offset", pa.int64()), ("error", pa.string()), ("tag", pa.string()), ("value", pa.string()), ("H", pa.string()), ("newest", pa.string()), ("sync", pa.bool_()), ("applied", pa.int64())])
            for e in b.to_pylist():
                if cell is None or e["pk"] != key:
                    end()
                    key, cell, applied = e["pk"], dummy(), 0
                    if len(out) >= 1000:
                        yield told(out)
                        out = []
                try:
                    if e["op"] == "state":
                        cell = json.loads(e["arg"])
                        cell["value"] = None if cell["value"] is None else json.loads(cell["value"])
                        continue
                    e["arg"] = None if e["arg"] is None else json.loads(e["arg"])
                    applied += bool(apply(cell, e, sync, device))
                except (Refused, KeyError, TypeError, ValueError, AttributeError) as error:
                    out.append((key, e["offset"], f"{type(error).__name__}: {error}", None, None, None, None, None, None))
        end()
        if out:
            yield told(out)

    reachable(events.sparkSession)
    shape = f"pk {kind.simpleString()}, {SHAPE}"
    return own.repartition("pk").sortWithinPartitions("pk", "offset").mapInArrow(run, shape)


def states(folded: DataFrame) -> DataFrame:
    return folded.filter("error is null").drop("offset", "error")


def dead_letters(folded: DataFrame) -> DataFrame:
    """pk, offset, error of the events that were refused."""
    return folded.filter("error is not null").select("pk", "offset", "error")


def is_dummy(folded: DataFrame) -> DataFrame:
    """States that no event has touched."""
    return folded.filter(F.col("H") == ZERO)
