"""An interactive shell: python -m planloom.shell [folder of csv files | folder of parquet tables]."""

from __future__ import annotations

import sys
import time
import traceback

from planloom.dialect import ParseError, parse, parse_expression
from planloom.dialect.syntax import outline
from planloom.engine import Engine

HELP = """<query>                     run a query
COMPILE [AND RUN] <query>   show the generated code, and run the query
PARSE <query or expression> show its syntax tree
EXPLAIN <query>             show the plans
LINEAGE <query>             run a query and show the row ids that each row comes from
TRACE                       show the last error's stack
SHOW TABLES                 list the tables
SHOW <table>                show a table's columns
help, q                     this text; leave"""


class Shell:
    """Answers one command at a time with text."""

    def __init__(self, engine: Engine):
        self.engine, self.trace = engine, ""

    def answer(self, line: str) -> str | None:
        """The text to print; None to leave."""
        line = line.strip()
        if line == "q":
            return None
        try:
            return self.command(line)
        except Exception as error:  # the shell goes on after any error
            self.trace = traceback.format_exc()
            return f"ERROR: {str(error).splitlines()[0] if str(error) else type(error).__name__}"

    def command(self, line: str) -> str:
        upper = line.upper()
        if not line:
            return ""
        if upper.startswith("HELP"):
            return HELP
        if upper == "TRACE":
            return self.trace or "no error yet"
        if upper == "SHOW TABLES":
            return "\n".join(self.engine.catalog.names)
        for word, act in (("PARSE", self.parse), ("SHOW", self.show), ("COMPILE", self.compile), ("EXPLAIN", self.explain), ("LINEAGE", self.lineage)):
            if upper.startswith(f"{word} "):
                return act(line[len(word) :].strip())
        return self.query(line)

    def parse(self, text: str) -> str:
        try:
            return outline(parse_expression(text))
        except ParseError:
            return outline(parse(text))

    def show(self, name: str) -> str:
        if name not in self.engine.catalog:
            return f"{name} not in database"
        return "\n".join([f"Schema for {name}", *(f"{n}\t{k}" for n, k in self.engine.catalog.schema(name))])

    def compile(self, text: str) -> str:
        run = text.upper().startswith("AND RUN ")
        query = text[len("AND RUN ") :] if run else text
        return "\n\n".join([self.engine.code(query), *([self.query(query)] if run else [])])

    def explain(self, text: str) -> str:
        return f"{self.engine.plan(text).pretty()}\n\n{self.engine.df(text)._jdf.queryExecution().toString()}"

    def query(self, text: str) -> str:
        began = time.perf_counter()
        rows = [", ".join(map(str, r)) for r in self.engine.df(text).toLocalIterator()]
        return "\n".join([*rows, f"{len(rows)} rows in {time.perf_counter() - began:.3f} seconds"])

    def lineage(self, text: str) -> str:
        lineage = self.engine.lineage(text)
        lines = [", ".join(map(str, r)) for r in lineage.result().orderBy("oid").collect()]
        for s in lineage.scans:
            lines += [s.alias, *(f"  {r['oid']} <- {r['iid']}" for r in lineage.edges(s).orderBy("oid", "iid").collect())]
        return "\n".join(lines)


def main(args: list[str]) -> None:
    from planloom.session import session

    engine = Engine(session(master="local[*]"))
    for folder in args:
        if not engine.catalog.crawl_csv(folder):
            path = engine.spark._jvm.org.apache.hadoop.fs.Path(folder)
            for f in path.getFileSystem(engine.spark._jsc.hadoopConfiguration()).listStatus(path):
                if f.getPath().getName().endswith(".parquet"):
                    engine.catalog.register_parquet(f.getPath().toString())
    shell = Shell(engine)
    while True:
        try:
            text = shell.answer(input("> "))
        except EOFError:
            return
        if text is None:
            return
        print(text)


if __name__ == "__main__":
    main(sys.argv[1:])
