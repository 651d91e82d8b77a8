"""Procedures and row predicates as registered Python callables, known by name or by the SHA-1 of their source."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable

import pandas as pd

from .functions import geo


class NoScript(LookupError):
    """A script that isn't loaded."""


class ReadOnly(RuntimeError):
    """A write from a read-only procedure."""


def _source(function: Callable) -> str:
    try:
        return inspect.getsource(function)
    except (OSError, TypeError):
        return function.__qualname__


class Scripts:
    """Procedures take (call, keys, args); predicates take one row (id, fields, properties) and args."""

    def __init__(self):
        self._by_sha: dict[str, Callable] = {}
        self._names: dict[str, str] = {}

    def load(self, function: Callable, source: str | None = None, name: str | None = None) -> str:
        sha = hashlib.sha1((source or _source(function)).encode()).hexdigest()
        self._by_sha[sha] = function
        self._names[name or function.__name__] = sha
        return sha

    def find(self, name: str) -> Callable:
        sha = name if name in self._by_sha else self._names.get(name)
        if sha is None:
            raise NoScript("No matching script. Please use EVAL.")
        return self._by_sha[sha]

    def exists(self, *shas: str) -> list[int]:
        return [int(s in self._by_sha) for s in shas]

    def flush(self) -> None:
        self._by_sha.clear()
        self._names.clear()

    def predicate(self, name: str, args: list[str]) -> Callable[[pd.DataFrame], pd.Series]:
        """A batch predicate from a row predicate. A row that it fails on by a missing value doesn't match."""
        return _Predicate(self.find(name), args)


class _Predicate:
    def __init__(self, function: Callable, args: list[str]):
        self.function, self.args = function, args

    def __call__(self, rows: pd.DataFrame) -> pd.Series:
        return pd.Series([self._one(*r) for r in rows[["id", "fields", "properties"]].itertuples(index=False, name=None)], dtype=bool)

    def _one(self, id_: str, fields: str, properties: str | None) -> bool:
        own = {k: _plain(v) for k, v in json.loads(fields or "{}").items()}
        try:
            out = self.function(id_, own, json.loads(properties) if properties else {}, self.args)
        except (KeyError, TypeError):
            return False
        return bool(out) and out is not None


def _plain(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


class Call:
    """What a procedure gets: `call(command, *args)`, `pcall` that returns the error, and helpers."""

    def __init__(self, run: Callable, read_only: bool):
        self._run, self.read_only = run, read_only

    def call(self, *args):
        if self.read_only and str(args[0]).lower() in WRITES:
            raise ReadOnly("read only")
        return self._run(*args)

    def pcall(self, *args):
        try:
            return self.call(*args)
        except Exception as e:  # the caller asked for the error as a value
            return {"err": str(e)}

    @staticmethod
    def error_reply(text: str) -> dict:
        return {"err": text}

    @staticmethod
    def status_reply(text: str) -> dict:
        return {"ok": text}

    @staticmethod
    def sha1hex(text: str) -> str:
        return hashlib.sha1(text.encode()).hexdigest()

    @staticmethod
    def distance_to(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
        return geo.distance(lat1, lon1, lat2, lon2)


#: Fixed value: commands that change data.
WRITES = {
    "set", "fset", "del", "pdel", "drop", "flushdb", "rename", "renamenx", "expire", "persist", "jset", "jdel", "sethook",
    "delhook", "pdelhook", "setchan", "delchan", "pdelchan", "massinsert", "aofshrink",
}
