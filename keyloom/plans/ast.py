"""Statements and expressions as dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: object
    kind: str


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Unary:
    op: str
    of: Expr


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


Expr = Literal | Name | Unary | Binary

LOGICAL, COMPARE, ARITHMETIC = ("AND", "OR"), ("==", "!=", "<", "<=", ">", ">="), ("+", "-", "*", "/")


@dataclass(frozen=True)
class Sort:
    column: str
    descending: bool = False

    def __str__(self) -> str:
        return f"{self.column} {'DESC' if self.descending else 'ASC'}"


@dataclass(frozen=True)
class Select:
    table: str
    columns: tuple[str, ...] | None
    where: Expr | None = None
    sort: Sort | None = None
    limit: int | None = None
    explain: bool = False


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[tuple[str, Literal], ...]


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Expr], ...]
    where: Expr | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None = None
    limit: int | None = None


@dataclass(frozen=True)
class CreateDatabase:
    name: str


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[tuple[str, str, bool], ...]


@dataclass(frozen=True)
class CreateIndex:
    table: str
    column: str
    background: bool = False


@dataclass(frozen=True)
class Show:
    what: str  # DATABASES, TABLES or INDEX
    table: str | None = None


@dataclass(frozen=True)
class Describe:
    table: str


@dataclass(frozen=True)
class Transaction:
    action: str  # START, COMMIT or ROLLBACK


Statement = Select | Insert | Update | Delete | CreateDatabase | CreateTable | CreateIndex | Show | Describe | Transaction


@dataclass(frozen=True)
class Needs:
    """What a kind of statement requires."""

    database: bool = True
    transaction: bool = False
    open_transaction: bool | None = field(default=None)


NEEDS: dict[type, Needs] = {
    Select: Needs(transaction=True), Insert: Needs(transaction=True), Update: Needs(transaction=True), Delete: Needs(transaction=True),
    CreateDatabase: Needs(database=False), CreateTable: Needs(), CreateIndex: Needs(), Show: Needs(), Describe: Needs(), Transaction: Needs(),
}


def names(e: Expr | None) -> set[str]:
    """Columns that an expression reads."""
    if isinstance(e, Name):
        return {e.name}
    if isinstance(e, Unary):
        return names(e.of)
    if isinstance(e, Binary):
        return names(e.left) | names(e.right)
    return set()
