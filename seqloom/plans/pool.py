"""Lazy plan nodes: a session, operations and pools. Nothing here touches Spark before a library is generated."""

from __future__ import annotations

import copy
import logging
import re
import tomllib
from collections.abc import Callable, Sequence
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.codons import CodonTable
from ..functions.dna import VALID_CHARS, let, strip_tags
from . import states as st
from . import styles
from .tags import find_all_regions, get_nontag_positions, tagged, validate_single_region

#: Most states that one sequential operation may have.
MAX_STATES = 1_000_000


class Region:
    """A named part of sequences: its length (None: varies, 0: a place for insertion). Equal by name."""

    def __init__(self, name: str, seq_length: int | None = None):
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise ValueError(f"{name!r} is no region name")
        if seq_length is not None and seq_length < 0:
            raise ValueError("a region's length is not negative")
        self.name, self.seq_length = name, seq_length

    @property
    def is_variable_length(self) -> bool:
        return self.seq_length is None

    @property
    def is_zero_length(self) -> bool:
        return self.seq_length == 0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Region) and self.name == other.name

    def __hash__(self) -> int:
        return hash(self.name)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.name!r}, {self.seq_length})"


FRAMES = (1, 2, 3, -1, -2, -3)


class OrfRegion(Region):
    def __init__(self, name: str, seq_length: int | None = None, frame: int = 1):
        super().__init__(name, seq_length)
        if frame not in FRAMES:
            raise ValueError(f"frame must be one of {FRAMES}")
        self.frame = frame


class Config:
    def __init__(self):
        self.suppress_styles = self.suppress_cards = False
        self.show_name = self.show_seq = self.show_pool_seqs = self.show_pool_states = self.show_op_states = True
        self.cards: dict[str, dict[str, bool]] = {}

    def load(self, path: str) -> None:
        with open(path, "rb") as f:
            data = tomllib.load(f)
        general, shown = data.get("general", {}), data.get("columns", {})
        self.suppress_styles = general.get("suppress_styles", self.suppress_styles)
        self.suppress_cards = general.get("suppress_cards", self.suppress_cards)
        for key in ("name", "seq", "pool_seqs", "pool_states", "op_states"):
            setattr(self, f"show_{key}", shown.get(key, getattr(self, f"show_{key}")))
        for factory, keys in data.get("design_cards", {}).items():
            self.cards.setdefault(factory, {}).update(keys)


_active: ContextVar[Session | None] = ContextVar("session", default=None)


class Session:
    """Identifiers, names, regions, outputs, genetic code and configuration of the plans built while it is active.

    Pools and operations are found by id or by name; the two kinds may share a name, within a kind names are unique. Regions
    keep their id when they become reading frames. Unknown pools and operations raise IndexError (id) or KeyError (name),
    unknown regions ValueError.
    """

    def __init__(self, genetic_code: str | dict = "standard"):
        self.codon_table = CodonTable(genetic_code)
        self.config = Config()
        self.manager = st.Manager()
        self.defaults: dict[str, object] = {}
        self._tokens = []
        self._forget()

    def _forget(self) -> None:
        self.ops: list[Operation] = []
        self.pools: list[Pool] = []
        self.names: dict[str, dict[str, Operation | Pool]] = {"pool": {}, "op": {}}
        self.regions: dict[str, Region] = {}
        self.outputs: dict[str, Pool] = {}

    def __enter__(self) -> Session:
        self._tokens.append(_active.set(self))
        self.manager.__enter__()
        return self

    def __exit__(self, *_) -> None:
        self.manager.__exit__()
        _active.reset(self._tokens.pop())

    def __repr__(self) -> str:
        return f"Session(outputs={list(self.outputs)})"

    def claim(self, kind: str, name: str, owner: Operation | Pool, old: str | None = None) -> str:
        """Give the owner this name in place of its old one."""
        known = self.names[kind]
        if known.get(name, owner) is not owner:
            raise ValueError(f"a {kind} named {name!r} exists")
        known.pop(old, None)
        known[name] = owner
        return name

    def free_name(self, kind: str, wanted: str) -> str:
        """The name wanted, with .2, .3, ... where it is taken."""
        return next(x for x in (wanted, *(f"{wanted}.{i}" for i in range(2, len(self.names[kind]) + 3))) if x not in self.names[kind])

    @property
    def state_manager(self) -> st.Manager:
        return self.manager

    @property
    def suppress_styles(self) -> bool:
        return self.config.suppress_styles

    @property
    def suppress_cards(self) -> bool:
        return self.config.suppress_cards

    def get_pool_by_id(self, number: int) -> Pool:
        return self.pools[number]

    def get_pool_by_name(self, name: str) -> Pool:
        return self.names["pool"][name]

    def get_op_by_id(self, number: int) -> Operation:
        return self.ops[number]

    def get_op_by_name(self, name: str) -> Operation:
        return self.names["op"][name]

    def register_region(self, name: str, seq_length: int | None = None) -> Region:
        old = self.regions.get(name)
        if old is None:
            self.regions[name] = old = Region(name, seq_length)
        elif old.seq_length != seq_length:
            raise ValueError(f"region {name!r} has length {old.seq_length}, not {seq_length}")
        return old

    def register_orf_region(self, name: str, seq_length: int | None, frame: int = 1) -> OrfRegion:
        """A new reading frame, or the one that is registered with this length and frame."""
        old, new = self.regions.get(name), OrfRegion(name, seq_length, frame)
        if old is None:
            self.regions[name] = old = new
        elif not isinstance(old, OrfRegion):
            raise ValueError(f"region {name!r} is no reading frame; upgrade_to_orf_region makes it one")
        elif (old.seq_length, old.frame) != (seq_length, frame):
            raise ValueError(f"region {name!r} has length {old.seq_length} and frame {old.frame}, not {seq_length} and {frame}")
        return old

    def upgrade_to_orf_region(self, name: str, frame: int = 1) -> OrfRegion:
        """Make a plain region a reading frame; a frame once given does not change."""
        old = self.get_region(name)
        if isinstance(old, OrfRegion):
            raise ValueError(f"region {name!r} has frame {old.frame}, which cannot change")
        self.regions[name] = new = OrfRegion(name, old.seq_length, frame)
        return new

    def get_region(self, name: str) -> Region:
        if name not in self.regions:
            raise ValueError(f"no region {name!r}, only {list(self.regions)}")
        return self.regions[name]

    get_region_by_name = get_region

    def get_region_by_id(self, number: int) -> Region:
        if not 0 <= number < len(self.regions):
            raise ValueError(f"no region {number} among {len(self.regions)}")
        return list(self.regions.values())[number]

    def has_region(self, name: str) -> bool:
        return name in self.regions

    def output(self, pool: Pool, name: str | None = None) -> None:
        """Mark a pool as an output, under its own or another name."""
        self.outputs[name or pool.name] = pool

    def print_graph(self, style: str = "clean") -> None:
        """The plans of all pools that no other pool uses."""
        from ..sources.sinks import plan_tree

        used = {q for p in self.pools for q in p.parents}
        for p in self.pools:
            if p not in used:
                print(plan_tree(p, style))

    def clear_pools(self) -> None:
        """Forget pools, operations, regions, outputs and states; genetic code, configuration and defaults stay."""
        self._forget()
        self.manager.states.clear()

    def set_genetic_code(self, genetic_code: str | dict) -> None:
        """The code of operations made from now on."""
        self.codon_table = CodonTable(genetic_code)

    def load_config(self, path: str) -> None:
        """Read the configuration from a TOML file; what the file leaves out is as in a new session."""
        self.config = Config()
        self.config.load(path)

    def set_default(self, key: str, value: object) -> None:
        self.defaults[key] = value
        if key == "iter_order":
            self.manager.order = value

    def get_default(self, key: str, fallback: object = None) -> object:
        return self.defaults.get(key, fallback)

    def load_defaults(self, path: str) -> None:
        """Read defaults from a TOML file."""
        with open(path, "rb") as f:
            for key, value in tomllib.load(f).items():
                self.set_default(key, value)

    def get_length_without_tags(self, seq: str) -> int:
        return len(strip_tags(seq))

    def get_molecular_positions(self, seq: str) -> list[int]:
        """Where the bases are, tags left out."""
        return [i for i in get_nontag_positions(seq) if seq[i] in VALID_CHARS]

    def get_effective_seq_length(self, seq: str) -> int:
        """How many bases, without gaps and tags."""
        return len(self.get_molecular_positions(seq))


def get_session() -> Session:
    found = _active.get()
    if found is None:
        raise RuntimeError("no active session; call init() or enter a Session")
    return found


def configure_logging(level: str = "WARNING", format: str = "%(levelname)s - %(name)s - %(message)s", handler: logging.Handler | None = None) -> None:  # noqa: A002
    """Show the package's messages of this level and above, by a handler of one's own or on the standard error stream."""
    if handler is None:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter(format))
    logger = logging.getLogger("seqloom")
    logger.setLevel(level.upper())
    logger.handlers[:] = [handler]


def init(genetic_code: str | dict = "standard", log_level: str | None = None) -> Session:
    """Start a new session and make it the active one."""
    if log_level is not None:
        configure_logging(log_level)
    session = Session(genetic_code)
    session.__enter__()
    return session


def row_generator(seed: int, op_id: int, state: int) -> np.random.Generator:
    return np.random.default_rng(np.random.SeedSequence([seed, op_id, state]))


class Draws:
    """Random numbers of a row as column expressions: hashes of (seed, operation, state, stream), then of an index.

    The same row gives the same numbers whatever the partitioning. Numbers have 62 bits.
    """

    BITS = 62
    #: Places that are put in random order are numbers below 2**PLACE; the higher bits of a number order them.
    PLACE = 24

    def __init__(self, run, state: Column):
        self.run, self.state, self.keys = run, state.cast("long"), {}

    def key(self, stream: int) -> Column:
        if stream not in self.keys:
            key = F.xxhash64(F.lit(self.run.seed).cast("long"), F.lit(self.run.op.id).cast("long"), self.state, F.lit(stream).cast("long"))
            self.keys[stream] = self.run.add(f"_h{self.run.op.id}x{stream}", key)
        return self.keys[stream]

    def long(self, stream: int, j: Column | int = 0) -> Column:
        number = F.xxhash64(self.key(stream), (F.lit(j) if isinstance(j, int) else j).cast("long"))
        return F.call_function("shiftrightunsigned", number, F.lit(64 - self.BITS))

    def below(self, n: Column | int, stream: int, j: Column | int = 0) -> Column:
        return (self.long(stream, j) % n).cast("int") if not isinstance(n, int) or n < 1 << 31 else self.long(stream, j) % n

    def happens(self, rate: float, stream: int, j: Column) -> Column:
        return self.long(stream, j) < int(rate * (1 << self.BITS))

    def ordered(self, places: Column, stream: int) -> Column:
        """The distinct places of an array in random order."""
        mask = (1 << self.PLACE) - 1
        number = lambda key, p: F.xxhash64(key, p.cast("long")).bitwiseAND(F.lit(~mask)).bitwiseOR(p.cast("long"))
        numbered = let(self.key(stream), lambda key: F.transform(places, lambda p: number(key, p)))
        return F.transform(F.sort_array(numbered), lambda x: x.bitwiseAND(F.lit(mask)).cast("int"))

    def chosen(self, places: Column, k: int, stream: int) -> Column:
        """k of the distinct places of an array, in order of size."""
        few = F.when(F.size(places) < k, F.raise_error(F.concat(F.lit(f"{k} to choose from "), F.size(places).cast("string")))).otherwise(places)
        return F.sort_array(F.slice(self.ordered(few, stream), 1, k))


def replaced(seq: Column, spots: Column, letters: Column) -> Column:
    """seq with the letters at the spots (in order of size): the stretches between spots, each after a letter."""

    def joined(spots: Column, letters: Column) -> Column:
        start = lambda t: F.when(t > 0, F.get(spots, t - 1) + 1).otherwise(0)
        stop = lambda t: F.when(t < F.size(spots), F.get(spots, t)).otherwise(F.length(seq))
        stretch = lambda t: F.concat(F.when(t > 0, F.get(letters, t - 1)).otherwise(""), seq.substr(start(t) + 1, stop(t) - start(t)))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(spots)), stretch), "")

    return let(spots, lambda p: let(letters, lambda x: joined(p, x)))


class Operation:
    """A transformation: ``build`` gives the sequence column and the provenance columns (cards) of a row.

    Subclasses or callers give ``build(run, args, state)`` for deterministic modes, and ``sample(run, args, draws)`` for random
    ones. A user's ``draw(rng, *strings)`` in Python, with the Spark types of what it returns, runs as an Arrow UDF seeded
    by (seed, id, state) instead.
    """

    factory = "operation"
    most_states: int | None = MAX_STATES
    #: How styles move: follow(run, masks, seqs, out, state) gives the mask of the output from those of the parents.
    follow: Callable = staticmethod(styles.same)
    #: What styles are added: paint(run, seqs, out, state) gives (specification, mask) pairs.
    paint: Callable | None = None

    def __init__(
        self,
        parents: Sequence[Pool],
        *,
        factory: str | None = None,
        mode: str = "fixed",
        num_states: int | None = None,
        natural: int | None = None,
        name: str | None = None,
        prefix: str | None = None,
        iter_order: int | None = None,
        region: str | Sequence[int] | None = None,
        remove_tags: bool = False,
        build: Callable | None = None,
        sample: Callable | None = None,
        draw: Callable | None = None,
        cards: dict[str, str] | None = None,
        name_parts: Callable | None = None,
    ):
        self.session = get_session()
        self.factory = factory or self.factory
        self.id = len(self.session.ops)
        self.session.ops.append(self)
        self.parents = list(parents)
        if mode not in ("fixed", "sequential", "random"):
            raise ValueError(f"unknown mode {mode!r}")
        if num_states is not None and num_states < 1:
            raise ValueError("num_states must be 1 or more")
        if self.most_states is not None and mode == "sequential" and (num_states or 1) > self.most_states:
            raise ValueError(f"{num_states} sequential states are more than {self.most_states}")
        if region is not None and not self.parents:
            raise ValueError("region needs a parent pool")
        if region is not None and not isinstance(region, str):
            a, b = region
            if not 0 <= a <= b:
                raise ValueError(f"no region interval: {region}")
        self.mode, self.num_states, self.natural = mode, num_states, natural or num_states or 1
        self.region, self.remove_tags, self.prefix = region, remove_tags, prefix
        self._build, self._sample, self._draw, self.cards, self._name_parts = build, sample, draw, cards or {}, name_parts
        self._name = self.session.claim("op", name or f"op[{self.id}]:{self.factory}", self)
        self.state = st.State(num_states or 1, f"{self.name}.state", iter_order)

    @property
    def name(self) -> str:
        return self._name

    @name.setter
    def name(self, new: str) -> None:
        self._name = self.session.claim("op", new, self, self._name)
        self.state.name = f"{new}.state"

    @property
    def parent_pools(self) -> list[Pool]:
        return self.parents

    @property
    def natural_num_states(self) -> int:
        """How many states there are without ``num_states``."""
        return self.natural

    @property
    def iter_order(self) -> int:
        return self.state.iter_order

    @iter_order.setter
    def iter_order(self, new: int) -> None:
        self.state.iter_order = new

    def copy(self, name: str | None = None) -> Operation:
        """The same operation on the same parents, with an id (and so random draws) and a state of its own."""
        return self._copied(self.parents, name)

    def deepcopy(self, name: str | None = None) -> Operation:
        """The same operation on copies of all it is made from; what it is made from twice is copied once."""
        done: dict[Pool, Pool] = {}
        return self._copied([p._deep(done) for p in self.parents], name)

    def _copied(self, parents: Sequence[Pool], name: str | None) -> Operation:
        new = copy.copy(self)
        new.id = len(self.session.ops)
        self.session.ops.append(new)
        new.parents = list(parents)
        new._name = self.session.claim("op", name or self.session.free_name("op", f"{self.name}.copy"), new)
        new.state = st.State(self.state.num_values, f"{new.name}.state", self.state.iter_order)
        return new

    def print_dag(self, style: str = "clean") -> None:
        """The tree of this operation and what it is made from."""
        from ..sources.sinks import operation_tree

        print(operation_tree(self, style))

    @property
    def from_state(self) -> bool:
        return self.mode != "random" or (self.num_states or 1) > 1

    def make_state(self) -> st.State:
        if self.parents:
            return st.ordered_product([*(p.state for p in self.parents), self.state])
        return st.synced_to(self.state)

    def build(self, run, args: list[Column], state: Column) -> tuple[Column, dict[str, Column]]:
        if self.mode == "random" and self._sample is not None:
            out = self._sample(run, args, Draws(run, state if self.from_state else run.row_key))
            return out if isinstance(out, tuple) else (out, {})
        if self.mode == "random" and self._draw is not None:
            return self._random(run, args, state)
        out = self._build(run, args, state)
        return out if isinstance(out, tuple) else (out, {})

    def _random(self, run, args: list[Column], state: Column) -> tuple[Column, dict[str, Column]]:
        draw, op_id, seed = self._draw, self.id, run.seed
        fields = ["seq", *self.cards]
        kinds = ", ".join(f"{k} {v}" for k, v in zip(fields, ["string", *self.cards.values()]))

        @F.pandas_udf(kinds)
        def drawn(index: pd.Series, *strings: pd.Series) -> pd.DataFrame:
            rows = []
            for s, *x in zip(index, *strings):
                rows.append((None,) * len(fields) if any(v is None for v in x) else draw(row_generator(seed, op_id, int(s)), *x))
            return pd.DataFrame(rows, columns=fields)

        index = state if self.from_state else run.row_key
        made = run.add(f"_u{self.id}", drawn(index, *args))
        return made["seq"], {k: made[k] for k in self.cards}

    def evaluate(self, run, args: list[Column], state: Column) -> tuple[Column, dict[str, Column]]:
        """``build`` on the region's content, put back in its place. NULL parents give NULL."""
        if self.region is None or not args:
            return self.build(run, args, state)
        before, inside, after = self._cut(run, args[0])
        new, cards = self.build(run, [inside, *args[1:]], state)
        if isinstance(self.region, str) and not self.remove_tags:
            new = tagged(self.region, new)
        return F.concat(before, new, after), cards

    def _cut(self, run, seq: Column) -> tuple[Column, Column, Column]:
        """What stands before, in and after the region."""
        if isinstance(self.region, str):
            return run.parts(self.parents[0], seq, self.region)
        a, b = self.region
        return F.substring(seq, 1, a), F.substring(seq, a + 1, b - a), seq.substr(F.lit(b + 1), F.length(seq))

    def layers(self, run, args: list[Column], out: Column, state: Column, parents: list[dict]) -> dict[tuple, tuple[str, Column]]:
        """The layers of style of the output (key: specification and mask), from those of the parents and its own."""
        keys = dict.fromkeys(k for p in parents for k in p)
        seqs, before, after, inner, spread = args, None, None, out, lambda mask: mask
        if self.region is not None and args:
            before, inside, after = self._cut(run, args[0])
            named = isinstance(self.region, str)
            ahead, behind = F.length(before), F.length(after)
            opening, closing = styles.tag_lengths(self.region) if named else (0, 0)
            skip = F.when(F.length(inside) == 0, 0).otherwise(opening)
            seqs = [inside, *args[1:]]
            rest = F.length(out) - ahead - behind
            kept = named and not self.remove_tags
            size = F.greatest(rest - opening - closing, F.lit(0)) if kept else rest
            inner = F.substr(out, ahead + 1 + (opening if kept else 0), size)
            spread = (lambda mask: styles.wrapped(self.region, mask)) if kept else (lambda mask: mask)
        made = {}
        for k in keys:
            spec = next(p[k][0] for p in parents if k in p)
            masks = [p[k][1] if k in p else styles.fill(F.length(a)) for p, a in zip(parents, args)]
            if before is None:
                made[k] = spec, self.follow(run, masks, seqs, inner, state)
                continue
            whole = masks[0]
            masks[0] = F.substr(whole, ahead + skip + 1, F.length(inside))
            moved = spread(self.follow(run, masks, seqs, inner, state))
            made[k] = spec, F.concat(F.substr(whole, F.lit(1), ahead), moved, F.substr(whole, F.length(args[0]) - behind + 1, behind))
        for i, (spec, mask) in enumerate(self.paint(run, seqs, inner, state) if self.paint else ()):
            if before is not None:
                mask = F.concat(styles.fill(ahead), spread(mask), styles.fill(behind))
            made[self.id, i] = spec, mask
        return made

    def name_parts(self, run, state: Column, max_row: int) -> list[Column]:
        """What the operation adds to a row's name."""
        if self._name_parts is not None:
            return self._name_parts(run, state)
        if self.prefix is None:
            return []
        if self.mode == "fixed":
            return [F.when(state.isNotNull(), F.lit(self.prefix))]
        if self.from_state:
            return [F.when(state.isNotNull(), numbered(self.prefix, state, self.state.num_values - 1))]
        return [F.when(state.isNotNull(), numbered(self.prefix, run.row, max_row))]

    def __repr__(self) -> str:
        return f"{type(self).__name__}(id={self.id}, name={self.name!r}, mode={self.mode!r}, num_states={self.num_states})"


def of_columns(f: Callable, example: object, columns: object) -> bool:
    """Whether a user's function works on columns: a function that does something with strings is one of strings, as operators like
    +, == and slices exist for both and mean different things."""
    for x in (example, columns):
        try:
            return isinstance(f(x), Column)
        except Exception:  # not made for such arguments
            continue
    return False


def numbered(prefix: str, value: Column, most: int) -> Column:
    """prefix_007: the value padded to the width of the largest (never cut)."""
    text = value.cast("string")
    return F.concat(F.lit(f"{prefix}_"), F.lpad(text, F.greatest(F.lit(len(str(most))), F.length(text)), F.lit("0")))


class Pool:
    """A lazy table of sequences: an operation with its index state. A pool is a DnaPool or a ProteinPool, by its kind."""

    kind = "dna"

    def __new__(cls, *args, kind: str = "dna", **options) -> Pool:
        return super().__new__({"dna": DnaPool, "protein": ProteinPool}[kind] if cls is Pool else cls)

    def __init__(self, operation: Operation, seq_length: int | None = None, name: str | None = None, state: st.State | None = None, regions: Sequence[str] = (), kind: str = "dna", template: str | None = None):
        self.session = operation.session
        self.id = len(self.session.pools)
        self.session.pools.append(self)
        self.operation = operation
        self.state = state or operation.make_state()
        self._name = self.session.claim("pool", name or f"pool[{self.id}]", self)
        self.state.name = f"{self._name}.state"
        self.seq_length, self.regions, self.kind, self.template = seq_length, dict.fromkeys(regions), kind, template
        #: whether the sequences are known to be of A, C, G and T alone
        self.plain = template is not None and not set(template) - VALID_CHARS
        self.cursor, self.seed = 0, None

    @property
    def name(self) -> str:
        return self._name

    @name.setter
    def name(self, new: str) -> None:
        self._name = self.session.claim("pool", new, self, self._name)
        self.state.name = f"{new}.state"

    def named(self, name: str, op_name: str | None = None) -> Pool:
        self.name = name
        if op_name is not None:
            self.operation.name = op_name
        return self

    @property
    def parents(self) -> list[Pool]:
        return self.operation.parents

    @property
    def num_states(self) -> int:
        return self.state.num_values

    @property
    def iter_order(self) -> int:
        return 0 if self.num_states == 1 else self.state.iter_order

    @iter_order.setter
    def iter_order(self, new: int) -> None:
        self.state.iter_order = new

    def has_region(self, name: str) -> bool:
        return name in self.regions

    def add_region(self, name: str, seq_length: int | None = None) -> None:
        """State that the sequences hold a region."""
        if name not in self.session.regions:
            self.session.register_region(name, seq_length)
        self.regions[name] = None

    def region_length(self, region: str | Sequence[int] | None) -> int | None:
        if region is None:
            return self.seq_length
        if not isinstance(region, str):
            return region[1] - region[0]
        if region not in self.regions:
            raise ValueError(f"pool {self.name} has no region {region!r}")
        return self.session.regions[region].seq_length if region in self.session.regions else None

    def molecular_length(self, region: str | Sequence[int] | None) -> int | None:
        """How many bases: counted where the sequence is a constant, else its length (taken to be free of gaps)."""
        if self.template is None:
            return self.region_length(region)
        text = self.template
        if isinstance(region, str):
            text = validate_single_region(text, region).content
        elif region is not None:
            text = text[region[0] : region[1]]
        return sum(c in VALID_CHARS for c in strip_tags(text))

    def __add__(self, other: Pool) -> Pool:
        return self.stack_with(other)

    def __mul__(self, times: int) -> Pool:
        return self.repeat(times)

    __rmul__ = __mul__

    def __getitem__(self, key: int | slice) -> Pool:
        return self.state_slice(key)

    def __repr__(self) -> str:
        return f"{type(self).__name__}(id={self.id}, name={self.name!r}, op={self.operation.name!r}, num_states={self.num_states})"

    def copy(self, name: str | None = None) -> Pool:
        """The same operation again on the same parents, with a new id (and so new random draws)."""
        return self._clone(self.parents, name)

    def deepcopy(self, name: str | None = None) -> Pool:
        """A pool that shares nothing with this one; what this one is made from twice is copied once."""
        out = self._deep({})
        return out.named(name) if name else out

    def _deep(self, done: dict[Pool, Pool]) -> Pool:
        if self not in done:
            done[self] = self._clone([p._deep(done) for p in self.parents], None)
        return done[self]

    def _clone(self, parents: Sequence[Pool], name: str | None) -> Pool:
        old, op = self.operation, self.operation._copied(parents, None)
        state = old.clone_state(op, self) if hasattr(old, "clone_state") else op.make_state()
        out = Pool(op, self.seq_length, name or self.session.free_name("pool", f"{self.name}.copy"), state, self.regions, kind=self.kind, template=self.template)
        out.plain = self.plain
        return out


class DnaPool(Pool):
    kind = "dna"


class ProteinPool(Pool):
    kind = "protein"


def as_pool(x: Pool | str) -> Pool:
    """A string stands for a pool of that one sequence."""
    if isinstance(x, Pool):
        return x
    from ..sources.sources import from_seq

    return from_seq(x)


def regions_in(text: str, session: Session) -> list[str]:
    """Register the regions of a literal and give their names."""
    names = []
    for r in find_all_regions(text):
        inner = len(strip_tags(r.content))
        if r.name in names:
            raise ValueError(f"region {r.name!r} occurs twice in {text!r}")
        if r.name not in session.regions:
            session.register_region(r.name, inner)
        names.append(r.name)
    return names


def make(op: Operation, seq_length: int | None, name: str | None = None, regions: Sequence[str] = (), **options) -> Pool:
    """A pool of the operation; with a region, the parent's regions stay and the length changes by the region's."""
    if op.region is not None and op.parents:
        parent = op.parents[0]
        old = parent.region_length(op.region)
        known = None not in (parent.seq_length, old, seq_length)
        regions = [r for r in [*parent.regions, *regions] if not (op.remove_tags and r == op.region)]
        seq_length = parent.seq_length - old + seq_length if known else None
    return Pool(op, seq_length, name, regions=regions, **options)
