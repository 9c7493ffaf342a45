"""Where libraries go: CSV, TSV, FASTA, JSON Lines, Parquet; previews and plan trees."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.colors import CSS_COLORS
from ..functions.formats import filled_in
from ..plans.pool import Operation, Pool
from ..plans.runner import generate_library, sorted_operations, stripped
from ..plans.states import State

FORMATS = ("csv", "tsv", "fasta", "jsonl", "parquet")


def _exported(pool: Pool, num_seqs, num_cycles, write_tags: bool, write_style: bool, seed, discard_null_seqs: bool, include_design_cards: bool, columns, options: dict) -> DataFrame:
    if (num_seqs is None) == (num_cycles is None):
        raise ValueError("give num_seqs or num_cycles")
    if num_seqs is not None and num_seqs < 1 or num_cycles is not None and num_cycles < 1:
        raise ValueError("num_seqs and num_cycles must be 1 or more")
    rejects = discard_null_seqs and num_seqs is not None and any(op.factory == "filter" for op in sorted_operations([pool]))
    options = {"init_state": 0, "report_design_cards": include_design_cards, "report_styles": write_style, "discard_null_seqs": rejects} | options
    df = generate_library(pool, num_seqs=num_seqs, num_cycles=num_cycles or 1, seed=seed, **options)
    if discard_null_seqs and not rejects and "seq" in df.columns:
        df = df.where(F.col("seq").isNotNull())
    if not write_tags and "seq" in df.columns:
        df = stripped(df)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def to_df(
    pool: Pool, num_seqs: int | None = None, num_cycles: int | None = None, chunk_size: int | None = None, write_tags: bool = False, write_style: bool = False, seed: int | None = None,
    discard_null_seqs: bool = True, include_design_cards: bool = False, columns: list[str] | None = None, show_progress: bool = False, *, remove_tags: bool = True, **options,
) -> DataFrame:
    """The library as a DataFrame: tags stripped unless ``write_tags``, rows without a sequence left out, columns picked.

    With ``num_seqs`` rows are made until there are so many sequences. ``chunk_size`` and ``show_progress`` change nothing: it is one job.
    """
    return _exported(pool, num_seqs, num_cycles, write_tags or not remove_tags, write_style, seed, discard_null_seqs, include_design_cards, columns, options)


def fasta_lines(df: DataFrame, description: str | Callable | None = None, line_width: int | None = 60) -> DataFrame:
    """One column, value: a FASTA record for each row that has a sequence."""
    head = F.concat(F.lit(">"), F.coalesce("name", F.lit("")) if "name" in df.columns else F.lit(""))
    if isinstance(description, str):
        head = F.concat(head, F.lit(" "), filled_in(description, df))
    elif description is not None:

        @F.pandas_udf("string")
        def described(rows: pd.DataFrame) -> pd.Series:
            return pd.Series([description(r) for r in rows.to_dict("records")])

        head = F.concat(head, F.lit(" "), described(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    seq = F.col("seq")
    if line_width:
        seq = F.regexp_replace(F.regexp_replace(seq, rf"(.{{{line_width}}})", "$1\n"), "\n$", "")
    return df.where(F.col("seq").isNotNull()).select(F.concat(head, F.lit("\n"), seq).alias("value"))


def write_library(df: DataFrame, path: str, file_type: str, *, compression: str | None = None, description=None, line_width: int | None = 60, **options) -> int:
    """Write a library DataFrame as a folder of part files; gives the number of rows, as the write itself observed it."""
    if file_type not in FORMATS:
        raise ValueError(f"file_type must be one of {FORMATS}")
    if compression is None and path.endswith(".gz"):
        compression = "gzip"
    squeeze = {"compression": compression} if compression else {}
    seen = Observation()
    counted = lambda x: x.observe(seen, F.count(F.lit(1)).alias("rows"))
    if file_type in ("csv", "tsv"):
        flat = df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(("array", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes])
        counted(flat).write.options(**{"header": True, "sep": "," if file_type == "csv" else "\t", **squeeze, **csv_settings(options)}).csv(path)
    elif file_type == "fasta":
        counted(fasta_lines(df, description, line_width)).write.options(**squeeze).text(path)
    elif file_type == "jsonl":
        rows = F.struct(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
        counted(df.select(F.to_json(rows, {"ignoreNullFields": "false"}).alias("value"))).write.options(**squeeze).text(path)
    else:
        counted(df).write.options(**squeeze).parquet(path)
    return seen.get["rows"]


# What the options of other CSV writers are called here.
CSV_NAMES = {"na_rep": "nullValue", "quotechar": "quote", "escapechar": "escape", "lineterminator": "lineSep", "date_format": "dateFormat"}
QUOTING = {0: {}, 1: {"quoteAll": True}, 3: {"quote": ""}}


def csv_settings(given: dict) -> dict:
    """Options of Spark's CSV writer. Names that other writers use (``na_rep``, ``quotechar``, ``quoting``, ...) are translated."""
    out = {}
    for key, value in given.items():
        if key == "index":
            if value:
                raise ValueError("rows have no index to write")
        elif key == "quoting":
            if value not in QUOTING:
                raise ValueError(f"quoting must be one of {list(QUOTING)}")
            out |= QUOTING[value]
        else:
            out[CSV_NAMES.get(key, key)] = value
    return out


def to_file(
    pool: Pool, path: str, file_type: str | None = None, num_seqs: int | None = None, num_cycles: int | None = None, chunk_size: int | None = None, write_tags: bool = False, write_style: bool = False,
    seed: int | None = None, discard_null_seqs: bool = True, include_design_cards: bool = False, columns: list[str] | None = None, line_width: int | None = 60, description: str | Callable | None = None,
    show_progress: bool = False, *, remove_tags: bool = True, compression: str | None = None, csv_options: dict | None = None, **options,
) -> int:
    """Write a library as a folder of part files; gives the number of rows written. Options as in ``to_df``, others are those of the CSV writer."""
    path = str(path)
    ending = path.removesuffix(".gz").rpartition(".")[2]
    file_type = file_type or ("fasta" if ending == "fa" else ending if ending in FORMATS else "csv")
    if file_type not in FORMATS:
        raise ValueError(f"file_type must be one of {FORMATS}")
    known = inspect.signature(generate_library).parameters
    settings = (csv_options or {}) | {k: v for k, v in options.items() if k not in known}
    if settings and file_type not in ("csv", "tsv"):
        raise TypeError(f"no options of {file_type} files: {list(settings)}")
    options = {k: v for k, v in options.items() if k in known}
    df = _exported(pool, num_seqs, num_cycles, write_tags or not remove_tags, write_style, seed, discard_null_seqs, include_design_cards, None if file_type == "fasta" else columns, options)
    return write_library(df, path, file_type, compression=compression, description=description, line_width=line_width, **settings)


# Three-letter codes of residues.
THREE_LETTERS = dict(zip("ARNDCQEGHILKMFPSTWYV*", "Ala Arg Asn Asp Cys Gln Glu Gly His Ile Leu Lys Met Phe Pro Ser Thr Trp Tyr Val Ter".split()))
# Escape codes of the basic colours and modes.
_colors = {"black": 30, "red": 91, "green": 92, "yellow": 93, "blue": 94, "magenta": 95, "cyan": 96, "white": 97}
_modes = {"bold": 1, "faint": 2, "italic": 3, "underline": 4, "blink": 5, "blinking": 5, "invert": 7, "reverse": 7}
_cases = ("upper", "lower", "uppercase", "lowercase", "swapcase")


def codes(spec: str) -> list[str]:
    """The escape codes of a style like 'bold red on_yellow #3366ff tomato 38;5;208': names, CSS names, hex colours, raw codes."""
    found = []
    for word in spec.split():
        back, name = word.startswith("on_"), word.removeprefix("on_")
        name_or_hex = name if name.startswith("#") else CSS_COLORS.get(name, "")
        if name in _colors:
            found.append(str(_colors[name] + 10 * back))
        elif name in _modes and not back:
            found.append(str(_modes[name]))
        elif re.fullmatch("#[0-9a-fA-F]{6}", name_or_hex):
            found.append(f"{48 if back else 38};2;" + ";".join(str(int(name_or_hex[i : i + 2], 16)) for i in (1, 3, 5)))
        elif re.fullmatch(r"[\d;]+", word):
            found.append(word)
        elif word not in _cases:
            raise ValueError(f"unknown style {word!r}")
    return found


def ansi(spec: str) -> str:
    found = codes(spec)
    return f"\033[{';'.join(found)}m" if found else ""


def print_named_colors() -> None:
    for name in dict.fromkeys([*_colors, *CSS_COLORS]):
        print(f"{ansi(name)}{name}\033[0m")


def _is_color(code: str, base: int) -> bool:
    """Whether a code sets the colour of letters (base 30) or of what is behind them (40)."""
    return code.startswith((f"{base + 8};2;", f"{base + 8};5;")) or code.isdigit() and int(code) in (*range(base, base + 8), *range(base + 60, base + 68))


def rendered(seq: str, styles: Sequence[tuple[str, Sequence[int]]]) -> str:
    """A sequence with styles as escape codes. Of colours the last one given to a character wins, other codes add up."""
    own: list[dict[str, str]] = [{} for _ in seq]
    chars = list(seq)
    for spec, places in styles:
        found, change = codes(spec), [w.removesuffix("case") if w != "swapcase" else w for w in spec.split() if w in _cases]
        for i in places:
            if not 0 <= i < len(seq):
                raise ValueError(f"place {i} of style {spec!r} is not in [0, {len(seq)})")
            for code in found:
                own[i]["0" if _is_color(code, 30) else "1" if _is_color(code, 40) else f"2{code}"] = code
            if change:
                chars[i] = getattr(seq[i], change[-1])()
    out, now = [], []
    for c, mine in zip(chars, own):
        new = [mine[k] for k in sorted(mine)]
        if new != now:
            out.append(("\033[0m" if now else "") + (f"\033[{';'.join(new)}m" if new else ""))
        now = new
        out.append(c)
    return "".join(out) + ("\033[0m" if now else "")


def print_library(
    pool: Pool, num_seqs: int | None = None, num_cycles: int | None = None, show_header: bool = True, show_state: bool = False, show_name: bool = True, show_seq: bool = True, pad_names: bool = True,
    seed: int | None = None, *, chars_per_aa: int = 1, aa_separator: str = " ", **options,
) -> Pool:
    """Print a few rows in their styles; gives the pool. Residues of proteins may have codes of three letters."""
    count = num_seqs if num_seqs is not None else (num_cycles or 1) * pool.num_states
    rows = generate_library(pool, num_seqs=count, seed=seed, init_state=0, report_styles=True, with_index=True, **options).orderBy("_row").collect()
    if show_header:
        print(f"{pool.name}: seq_length={pool.seq_length}, num_states={pool.num_states}")
    width = max((len(r["name"] or "") for r in rows), default=0) if pad_names else 0
    for r in rows:
        seq, looks = r["seq"], [(s["spec"], s["positions"]) for s in r["styles"] or ()]
        if seq is not None and chars_per_aa == 3:
            step = 3 + len(aa_separator)
            looks = [(spec, [p * step + j for p in places for j in range(3)]) for spec, places in looks]
            seq = aa_separator.join(THREE_LETTERS.get(c.upper(), c * 3) for c in seq)
        shown = [str(r["_row"] % pool.num_states)] if show_state else []
        shown += [r["name"].ljust(width)] if show_name and r["name"] else []
        shown += ["None" if seq is None else rendered(seq, looks)] if show_seq else []
        print("\t".join(shown))
    return pool


def plan_tree(pool: Pool, style: str = "clean", show_pools: bool = True) -> str:
    """The plan as an indented tree of pools and the operations that made them, or of operations alone."""
    return _tree(pool.operation, style, pool if show_pools else None)


def operation_tree(operation: Operation, style: str = "clean") -> str:
    """The tree of an operation that need not be that of a pool."""
    return _tree(operation, style, None, pools_below=True)


def _tree(operation: Operation, style: str, pool: Pool | None, pools_below: bool | None = None) -> str:
    if style not in ("clean", "minimal", "repr"):
        raise ValueError(f"unknown style {style!r}")
    with_pools = pool is not None if pools_below is None else pools_below
    lines = []

    def label(op: Operation, p: Pool | None) -> str:
        made = {"clean": f"{op.name} [{op.mode}, n={op.state.num_values}]", "minimal": op.name, "repr": repr(op)}[style]
        if p is None:
            return made
        return {"clean": f"{p.name} [n={p.num_states}] <- {made}", "minimal": p.name, "repr": f"{p!r} <- {made}"}[style]

    def visit(op: Operation, p: Pool | None, lead: str, last: bool, top: bool) -> None:
        lines.append(label(op, p) if top else f"{lead}{'└── ' if last else '├── '}{label(op, p)}")
        deeper = "" if top else lead + ("    " if last else "│   ")
        for i, q in enumerate(op.parents):
            visit(q.operation, q if with_pools else None, deeper, i == len(op.parents) - 1, False)

    visit(operation, pool, "", True, True)
    return "\n".join(lines)


def state_tree(state: State, style: str = "clean") -> str:
    if style not in ("clean", "minimal", "repr"):
        raise ValueError(f"unknown style {style!r}")
    lines = []

    def visit(s: State, depth: int) -> None:
        lines.append("    " * depth + {"clean": f"{s.name} [{s.kind}, n={s.num_values}]", "minimal": s.name, "repr": repr(s)}[style])
        for p in s.parents:
            visit(p, depth + 1)

    visit(state, 0)
    return "\n".join(lines)


def print_dag(pool: Pool, style: str = "clean", show_pools: bool = True) -> Pool:
    print(plan_tree(pool, style, show_pools))
    return pool
