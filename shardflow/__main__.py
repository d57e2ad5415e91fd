"""python -m shardflow send TOPIC [FILE] | receive TOPIC: lines to a topic directory, and all its lines."""

from __future__ import annotations

import argparse
import sys

from shardflow.session import local_session
from shardflow.sinks import send
from shardflow.sources import slice_of
from shardflow.streaming import receive


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="shardflow", description=__doc__)
    p.add_argument("verb", choices=["send", "receive"])
    p.add_argument("topic")
    p.add_argument("file", nargs="?")
    a = p.parse_args(argv)
    spark = local_session()
    if a.verb == "receive":
        stream = receive(spark, a.topic)
        stream.writeStream.foreachBatch(lambda d, _: [print(r.value) for r in d.toLocalIterator()]).trigger(availableNow=True).start().awaitTermination()
        return 0
    with open(a.file, encoding="utf-8") if a.file else sys.stdin as f:
        rows = spark.read.text(a.file) if a.file else slice_of(spark, (x.rstrip("\n") for x in f), "value string")
    send(rows, a.topic)
    return 0


if __name__ == "__main__":
    sys.exit(main())
