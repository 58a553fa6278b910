"""python -m ledgerloom --corpus FOLDER --index FOLDER [--model NAME] [--rebuild] [--stats]"""

from __future__ import annotations

import argparse

from .session import build_session
from .sources.index import build_index, read_index


def main() -> None:
    p = argparse.ArgumentParser(prog="ledgerloom", description="Bring an index in line with a folder of files.")
    p.add_argument("--corpus", required=True)
    p.add_argument("--index", required=True)
    p.add_argument("--model", default="hashing-64")
    p.add_argument("--rebuild", action="store_true")
    p.add_argument("--stats", action="store_true")
    a = p.parse_args()
    spark = build_session()
    counts = build_index(spark, a.corpus, a.index, embed_model=a.model, rebuild=a.rebuild)
    print(", ".join(f"{n} {k}" for k, n in counts.items()))
    if a.stats:
        for name, df in read_index(spark, a.index).items():
            print(f"{name}: {df.count()}")


if __name__ == "__main__":
    main()
