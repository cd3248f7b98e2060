"""What a search table and a query are. Queries are plain values; they are compiled to DataFrame expressions."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

MODES = ("off", "ascii", "all")
WIDTHS = ("keep", "narrow", "wide")
OPS = {"=": "=", "==": "=", "EQ": "=", "!=": "!=", "<>": "!=", "NE": "!=", ">": ">", "GT": ">", ">=": ">=", "≥": ">=", "GTE": ">=", "<": "<", "LT": "<", "<=": "<=", "≤": "<=", "LTE": "<="}
NULL_OPS = ("IS NULL", "IS NOT NULL")
MOST_TERMS, MOST_LIMIT, MOST_VALUE_BYTES = 64, 1000, 1024


@dataclass(frozen=True)
class Expression:
    """A boolean expression over terms: Term("a") & (Term("b") | ~Term("c"))."""

    def __and__(self, other: Expression) -> Expression:
        return Both(self, other)

    def __or__(self, other: Expression) -> Expression:
        return Either(self, other)

    def __invert__(self) -> Expression:
        return Not(self)

    def terms(self, positive: bool = True) -> list[str]:
        """Terms that stand under an even number of negations (with positive=False: all)."""
        raise NotImplementedError


@dataclass(frozen=True)
class Term(Expression):
    text: str

    def terms(self, positive: bool = True) -> list[str]:
        return [self.text]


@dataclass(frozen=True)
class Both(Expression):
    left: Expression
    right: Expression

    def terms(self, positive: bool = True) -> list[str]:
        return self.left.terms(positive) + self.right.terms(positive)


@dataclass(frozen=True)
class Either(Both):
    pass


@dataclass(frozen=True)
class Not(Expression):
    of: Expression

    def terms(self, positive: bool = True) -> list[str]:
        if not positive:
            return self.of.terms(False)
        return self.of.of.terms() if isinstance(self.of, Not) else []


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: str

    def __post_init__(self) -> None:
        if self.op.upper() not in OPS:
            raise ValueError(f"no such operator: {self.op}")
        if len(self.value.encode()) > MOST_VALUE_BYTES:
            raise ValueError("a filter's value is too long")
        object.__setattr__(self, "op", OPS[self.op.upper()])


@dataclass(frozen=True)
class Required:
    """A rule that rows must pass to get into a table; unlike filters of queries, it also asks for nulls and takes dates."""

    column: str
    op: str
    value: str = ""

    def __post_init__(self) -> None:
        op = " ".join(self.op.upper().split())
        if op not in NULL_OPS and op not in OPS:
            raise ValueError(f"no such operator: {self.op}")
        object.__setattr__(self, "op", OPS.get(op, op))


@dataclass(frozen=True)
class Highlight:
    open: str = "<em>"
    close: str = "</em>"
    snippet_len: int = 100
    max_fragments: int = 3

    def __post_init__(self) -> None:
        if max(len(self.open.encode()), len(self.close.encode())) > 256:
            raise ValueError("a tag is longer than 256 bytes")
        if not 1 <= self.snippet_len <= 10_000 or not 1 <= self.max_fragments <= 100:
            raise ValueError("snippet_len or max_fragments is out of range")


@dataclass(frozen=True)
class TableSpec:
    """Which columns are key, text (several are joined by a delimiter) and filters, and how its texts are matched."""

    key: str
    text: tuple[str, ...]
    filters: tuple[str, ...] = ()
    n: int = 2
    kanji: int = 0
    cross: bool = True
    delimiter: str = " "
    verify: str = "off"
    nfkc: bool = True
    width: str = "narrow"
    lower: bool = False
    required: tuple[Filter | Required, ...] = ()
    types: tuple[tuple[str, str], ...] = ()  # of filter columns that come as texts, see functions.values.typed
    unique: bool = False  # whether a key that occurs twice is an error

    def __post_init__(self) -> None:
        if self.verify not in MODES:
            raise ValueError(f"verify is none of {MODES}")
        if self.width not in WIDTHS:
            raise ValueError(f"width is none of {WIDTHS}")
        if self.n < 1 or self.kanji < 0 or not self.key or not self.text:
            raise ValueError("a table needs a key, text columns and n-grams of one character at least")

    @classmethod
    def from_dict(cls, body: dict) -> TableSpec:
        """From the JSON form; unknown names are errors."""
        required = tuple(Required(r["column"], r["op"], str(r.get("value", ""))) for r in body.get("required", ()))
        lists = {k: tuple(body[k]) for k in ("text", "filters") if k in body}
        return cls(**{**body, **lists, "required": required, "types": tuple(sorted(body.get("types", {}).items()))})

    def to_dict(self) -> dict:
        required = [{"column": r.column, "op": r.op, "value": r.value} for r in self.required]
        return {**{f.name: getattr(self, f.name) for f in fields(self)}, "text": list(self.text), "filters": list(self.filters), "required": required, "types": dict(self.types)}


@dataclass(frozen=True)
class Query:
    """text and all are terms that must match, none terms that mustn't; expression takes the place of text."""

    text: str | None = None
    expression: Expression | None = None
    all: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    fuzzy: int = 0
    sort: str | None = None  # a column, "score", or the key
    ascending: bool = False
    limit: int = 100
    offset: int = 0
    highlight: Highlight | None = None
    terms: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        if max(len(self.all), len(self.none), len(self.filters)) > MOST_TERMS:
            raise ValueError(f"more than {MOST_TERMS} terms or filters")
        if not 1 <= self.limit <= MOST_LIMIT or self.offset < 0:
            raise ValueError("limit or offset is out of range")
        if self.fuzzy not in (0, 1, 2):
            raise ValueError("fuzzy is an edit distance of 1 or 2, or 0")
        first = () if self.text is None else (self.text,)
        object.__setattr__(self, "terms", first + self.all)

    @classmethod
    def from_dict(cls, body: dict) -> Query:
        """From the JSON form: q, mode (literal, or boolean: q is an expression), all, none, filters ({column: value} or {column: {op, value}}), sort, limit, offset, fuzzy, highlight."""

        def text_of(v: object) -> str:
            return ("1" if v else "0") if isinstance(v, bool) else f"{v:.6f}" if isinstance(v, float) else str(v)

        filters = tuple(Filter(c, v.get("op", "="), text_of(v["value"])) if isinstance(v, dict) else Filter(c, "=", text_of(v)) for c, v in body.get("filters", {}).items())
        sort = body.get("sort") or {}
        q, expression = body.get("q"), None
        if body.get("mode", "literal") not in ("literal", "boolean"):
            raise ValueError("mode is literal or boolean")
        if body.get("mode") == "boolean" and q is not None:
            from sparklex.plans.language import boolean

            q, expression = None, boolean(q)
        return cls(
            text=q, expression=expression, all=tuple(body.get("all", ())), none=tuple(body.get("none", ())), filters=filters, fuzzy=body.get("fuzzy", 0), sort=sort.get("column"), ascending=sort.get("order", "desc").lower() == "asc",
            limit=body.get("limit", 100), offset=body.get("offset", 0), highlight=Highlight(**body["highlight"]) if body.get("highlight") else None,
        )

    def key(self) -> tuple:
        """What makes the set of matches; paging and order aside. For caches."""
        return replace(self, limit=1, offset=0, sort=None, ascending=False, highlight=None), tuple(sorted(self.all)), tuple(sorted(self.none))
