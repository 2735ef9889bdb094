"""Types and key extractors that a session adds to the dialect.

Both are written as Spark SQL in which {x} stands for a value, so Catalyst plans them like built-in types.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Before a user type's name in kinds.
MARK = "type:"


@dataclass(frozen=True)
class UserType:
    """A type over a stored one: its values are the stored values for which valid holds.

    stored is a built-in type of the dialect (int, real, text, date, blob). read makes a stored value from text
    (CAST and name 'text'), shown makes text. Values compare, sort and group as their stored values do, with
    their own type and with text, which is read first; with ordered=False only = and <> compare.
    """

    name: str
    stored: str = "text"
    valid: str = "true"
    read: str = "{x}"
    shown: str = "CAST({x} AS STRING)"
    ordered: bool = True

    def from_text(self, text: str) -> str:
        """The stored value of a text; an error where it is not valid, null for null."""
        made = self.read.replace("{x}", f"({text})")
        valid = self.valid.replace("{x}", f"({made})")
        return f"CASE WHEN ({text}) IS NULL THEN NULL WHEN coalesce({valid}, false) THEN {made} ELSE raise_error('type: not a {self.name}') END"


@dataclass(frozen=True)
class Extractor:
    """Keys of a value: an array in Spark SQL, of no, one or many keys of a text or int kind."""

    name: str
    keys: str

    def contains(self, value: str, key: str) -> str:
        """Whether the value has the key; a missing value or key is false, not unknown."""
        return f"coalesce(array_contains({self.keys.replace('{x}', f'({value})')}, {key}), false)"
