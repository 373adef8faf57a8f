"""python -m skerry FOLDER: index a folder and answer queries until exit or quit. python -m skerry serve FOLDER [PORT]: answer them over HTTP."""

import sys

from pyspark.sql import SparkSession

from .plans.engine import SearchEngine, configure_logging


def main(arguments: list[str]) -> int:
    serving = arguments[:1] == ["serve"]
    if not 1 <= len(arguments) - serving <= 1 + serving:
        print(__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    if serving:
        from .operators.analytics import QueryLog
        from .plans.service import serve
        from .sources.cut import shared_folder

        configure_logging()
        engine = SearchEngine(spark, QueryLog(spark, f"{shared_folder(spark)}/query-log"))
        engine.index_folder(arguments[1])
        serve(engine, port=int(arguments[2]) if len(arguments) > 2 else 8000)
        return 0
    engine = SearchEngine(spark)
    print(f"{engine.index_folder(arguments[0])} documents indexed")
    while (query := input("> ").strip()) not in ("exit", "quit"):
        for r in engine.search(query).collect():
            print(r["doc_id"], r["title"], r["source_path"])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
