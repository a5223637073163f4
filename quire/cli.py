"""Command line for an engine's root: list, inspect, back up, restore, check.

    python -m quire.cli ROOT [--read-only] [COMMAND ARGS...]

Without a command it reads commands from the standard input, one a line; `help` lists them.
"""

from __future__ import annotations

import argparse
import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.errors import QuireError
from quire.functions.scalar import humanize, round_significant, tokens
from quire.operators import storage as st
from quire.plans.engine import STORAGE, Engine
from quire.sources import backup

PAGE = 25


class Shell:
    def __init__(self, engine: Engine, out: TextIO = sys.stdout):
        self.engine, self.out = engine, out
        self.name: str | None = None
        self.rows: DataFrame | None = None
        self.at = 0

    def say(self, *x: object) -> None:
        print(*x, file=self.out)

    def show(self, df: DataFrame, n: int = PAGE) -> int:
        rows = df.limit(n).collect()
        for r in rows:
            self.say("\t".join("" if v is None else str(v) for v in r))
        return len(rows)

    def run(self, line: str) -> bool:
        """Runs one command; False to stop."""
        words = tokens(line)
        if not words:
            return True
        command = getattr(self, f"do_{words[0]}", None)
        if command is None:
            self.say("unknown command:", words[0])
            return True
        try:
            return command(*words[1:]) is not False
        except (QuireError, KeyError, TypeError, ValueError) as e:
            self.say(f"{type(e).__name__}: {e}")
            return True

    def _current(self) -> str:
        if self.name is None:
            raise ValueError("use a collection first")
        return self.name

    def do_help(self) -> None:
        self.say(*sorted(n[3:] for n in dir(self) if n.startswith("do_")))

    def do_quit(self) -> bool:
        return False

    def do_list(self) -> None:
        self.show(self.engine.list(), 255)

    def do_system_table(self) -> None:
        self.say("version", self.engine.version)
        self.do_list()
        self.do_variables()

    def do_levels(self) -> None:
        for r in self.engine.stats().collect():
            self.say(r["name"], f"{r['files']} files", f"{humanize(round_significant(r['bytes']))}B")

    def do_use(self, name: str) -> None:
        if name not in self.engine.collections:
            raise KeyError(name)
        self.name, self.rows, self.at = name, None, 0

    def do_create(self, name: str, purpose: str) -> None:
        self.engine.open_table(name, purpose)

    def do_erase_table(self, name: str) -> None:
        self.engine.delete_table(name)

    def do_first(self, n: str = str(PAGE)) -> None:
        self._page(False, int(n))

    def do_last(self, n: str = str(PAGE)) -> None:
        self._page(True, int(n))

    def _page(self, backward: bool, n: int) -> None:
        v = self.engine.view(self._current())
        self.rows = (v.reverse() if backward else v).rows()
        self.at = self.show(self.rows, n)

    def do_seek(self, *key: str) -> None:
        v = self.engine.view(self._current())
        self.rows = v.select_from(self._key(v, key)).rows()
        self.at = self.show(self.rows)

    def do_select(self, *key: str) -> None:
        v = self.engine.view(self._current())
        self.rows = v.select(self._key(v, key)).rows()
        self.at = self.show(self.rows)

    @staticmethod
    def _key(v: object, key: tuple[str, ...]) -> tuple:
        names = [k if isinstance(k, str) else k.name for k in v.keys]
        kinds = dict(v.df.dtypes)
        return tuple(int(x) if kinds[n] in ("bigint", "int") else float(x) if kinds[n] == "double" else x for n, x in zip(names, key, strict=False))

    def do_rewind(self) -> None:
        if self.rows is not None:
            self.at = self.show(self.rows)

    def do_document(self, doc_id: str) -> None:
        if self.name and self.engine.collections[self.name].purpose == STORAGE:
            self.show(st.find(self.engine.read(self.name), int(doc_id)))
        elif (found := self.engine.find_everywhere(int(doc_id))) is not None:
            self.show(found)

    def do_purge(self, doc_id: str) -> None:
        ids = self.engine.spark.createDataFrame([(int(doc_id),)], "id long")
        self.engine.purge(self._current(), ids)

    def do_compact(self, n: str = "0", deleted: str = "") -> None:
        self.engine.compact(self._current(), int(n), deleted=deleted == "deleted")

    def do_backup(self, path: str, start: str = "0") -> None:
        """Writes the records of the storage, from an id on, as a binary backup."""
        name = self._current()
        self.say(backup.write_binary(self.engine.read(name), path, self.engine.collections[name].next_id, start=int(start)))

    def do_restore(self, path: str) -> None:
        """Takes over the records of a backup, binary or exported, that the storage lacks."""
        spark, files = self.engine.spark, self.engine.files
        folder = files.path(path)
        inside = [f.getPath().getName() for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
        rows = st.read_backup(spark, path) if any(n.endswith(".parquet") for n in inside) else backup.read_binary(spark, path)
        self.engine.restore_backup(self._current(), rows)

    def do_chkstorage(self) -> None:
        if not self.show(self.engine.check_storage(self._current())):
            self.say("no problem found")

    def do_chkref(self, repair: str = "") -> None:
        if not self.show(self.engine.check_references(self._current(), repair=repair == "repair")):
            self.say("no dangling reference")

    def do_private(self) -> None:
        c = self.engine.collections[self._current()]
        self.say("revision", c.revision, "last seen", c.last_seen, *[f"{k}={v}" for k, v in c.private.items()])

    def do_count(self) -> None:
        self.say(self.engine.read(self._current()).agg(F.count(F.lit(1))).first()[0])

    def do_variables(self) -> None:
        for k, v in sorted(self.engine.variables.items()):
            self.say(f"{k}={v}")

    def do_set_var(self, name: str, value: str) -> None:
        self.engine.set_variable(name, value)

    def do_unset_var(self, name: str) -> None:
        self.engine.set_variable(name, "")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quire", description=__doc__.split("\n")[0])
    p.add_argument("root")
    p.add_argument("--read-only", action="store_true")
    p.add_argument("--version", type=int)
    p.add_argument("command", nargs=argparse.REMAINDER)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("quire").getOrCreate()
    with Engine(spark, a.root, read_only=a.read_only, version=a.version) as engine:
        shell = Shell(engine)
        if a.command:
            shell.run(" ".join(a.command))
            return 0
        for line in sys.stdin:
            if not shell.run(line):
                break
    return 0


if __name__ == "__main__":
    sys.exit(main())
