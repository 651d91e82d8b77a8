"""Where messages go: endpoints by URL, tried in order until one takes the message, and channels in memory.

`deliver` writes a stream of messages through `foreachBatch`: at least once, with (hook, key, id, seq, detect) to tell
repeats by. The clients of message systems are in `clients`.
"""

from __future__ import annotations

import json
import logging
import time
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import parse_qsl, urlsplit

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import globs
from ..plans.session import ship
from . import clients
from .clients import Endpoint

#: Seconds that an undelivered message lives, and between two tries.
LIFE, RETRY = 30.0, 0.5

_log = logging.getLogger(__name__)


class Undelivered(RuntimeError):
    """No endpoint took the message."""


def parse_endpoint(url: str) -> Endpoint:
    if url.startswith("Endpoint="):
        return Endpoint("eventhub", options=dict(p.split("=", 1) for p in url.split(";") if "=" in p), url=url)
    parts = urlsplit(url)
    if parts.scheme not in {"local", "file", "kafka", *clients.SENDERS} - {"eventhub"}:
        raise ValueError(f"unknown scheme '{parts.scheme}'")
    if parts.scheme != "file" and not parts.netloc:
        raise ValueError("missing channel" if parts.scheme == "local" else "missing host")
    options = dict(parse_qsl(parts.query))
    # These hold names, not machines: their case counts, and what follows a colon is no port.
    if parts.scheme in ("local", "sqs", "pubsub", "cf-queue"):
        return Endpoint(parts.scheme, parts.netloc, None, parts.path, options, url)
    scheme = parts.scheme
    if scheme == "https" and parts.hostname and parts.hostname.startswith("sqs.") and parts.hostname.endswith(".amazonaws.com"):
        scheme = "sqs"
    return Endpoint(scheme, parts.hostname or "", parts.port, parts.path, options, url)


class Channels:
    """In-process channels: publish to a name, subscribe to names or globs."""

    def __init__(self):
        self._by_name: dict[str, list[Callable[[str, str], None]]] = defaultdict(list)
        self._by_glob: list[tuple[str, Callable[[str, str], None]]] = []

    def subscribe(self, name: str, take: Callable[[str, str], None]) -> None:
        self._by_name[name].append(take)

    def psubscribe(self, pattern: str, take: Callable[[str, str], None]) -> None:
        self._by_glob.append((pattern, take))

    def unsubscribe(self, name: str) -> None:
        self._by_name.pop(name, None)

    def punsubscribe(self, pattern: str) -> None:
        self._by_glob = [(p, t) for p, t in self._by_glob if p != pattern]

    def publish(self, name: str, message: str) -> int:
        """How many took it."""
        takers = [*self._by_name.get(name, []), *(t for p, t in self._by_glob if globs.match(p, name))]
        for take in takers:
            take(name, message)
        return len(takers)


def _file(e: Endpoint, message: str) -> None:
    with open(e.path, "a", encoding="utf-8") as f:
        f.write(message + "\n")


class Sender:
    """Sends to the first endpoint that works. `senders` adds or replaces a scheme's function (endpoint, message)."""

    def __init__(self, channels: Channels | None = None, senders: dict[str, Callable[[Endpoint, str], None]] | None = None):
        self.channels, self.own = channels or Channels(), senders or {}
        self.senders = clients.SENDERS | {"file": _file, "local": lambda e, m: self.channels.publish(e.host, m)} | self.own

    def send(self, urls: list[str], message: str) -> str:
        why = []
        for url in urls:
            e = parse_endpoint(url)
            try:
                if e.scheme not in self.senders:
                    raise Undelivered(f"no sender is registered for {e.scheme}")
                self.senders[e.scheme](e, message)
                return url
            except (OSError, ImportError, Undelivered) as x:
                why.append(f"{url}: {x}")
        raise Undelivered("; ".join(why) or "no endpoints")


def send_rows(rows: Iterable[Row], endpoints: dict[str, list[str]], sender: Sender, life: float = LIFE, retry: float = RETRY) -> Iterator[Row]:
    """Send messages in the order given; what stays undelivered comes back.

    A message that no endpoint takes is tried again until it is `life` seconds old, counted from the start, and the hook's
    later messages wait for it; then it is given up. Later ones of that hook get one try each until one succeeds, so a dead
    endpoint holds its messages up once, not once a message.
    """
    ends = time.monotonic() + life
    for row in rows:
        while True:
            try:
                sender.send(endpoints[row.hook], row.message)
                break
            except Undelivered as x:
                if time.monotonic() + retry > ends:
                    _log.warning("hook %s, seq %s: %s", row.hook, row.seq, x)
                    yield row
                    break
                time.sleep(retry)


def _to_kafka(df: DataFrame, e: Endpoint) -> None:
    key = F.concat_ws("-", "key", "id")
    df.select(key.alias("key"), F.col("message").alias("value")).write.format("kafka").options(**clients.kafka_options(e)).save()


def deliver(messages: DataFrame, endpoints: dict[str, list[str]], sender: Sender, life: float = LIFE, retry: float = RETRY) -> DataStreamWriter:
    """A stream writer that sends each message (hook, key, id, seq, ..., message) to its hook's endpoints, in order of seq.

    Hooks with endpoints are sent by executors, one task a hook at a time since a hook's messages have an order, so a slow
    or dead endpoint holds up its own hook and those dealt to the same task. A hook whose first endpoint is Kafka is
    written by Spark's Kafka writer, which retries by itself, and by its other endpoints if that fails. Undelivered messages are tried again for `life`
    seconds, then logged and dropped; they never make the batch run again. Channels, `local:` endpoints and functions
    given to the sender live in the driver, which reads their messages partition by partition.
    """
    parsed = {h: [parse_endpoint(u) for u in urls] for h, urls in endpoints.items()}
    inside = {h for h, es in parsed.items() if any(e.scheme == "local" or e.scheme in sender.own for e in es)}
    kafka = {h: es[0] for h, es in parsed.items() if h not in inside and es[0].scheme == "kafka"}
    away = sorted(set(endpoints) - inside - set(kafka))

    def send_away(df: DataFrame, own: dict[str, list[str]]) -> None:
        ship(df.sparkSession)

        def run(rows: Iterator[Row]) -> None:
            for _ in send_rows(rows, own, Sender(), life, retry):
                pass

        part = df.filter(F.col("hook").isin(list(own))).select("hook", "seq", "message")
        part.repartition(min(len(own), 200), "hook").sortWithinPartitions("hook", "seq").foreachPartition(run)

    def batch(df: DataFrame, _: int) -> None:
        here = df if not away and not kafka else df.filter(~F.col("hook").isin([*away, *kafka]))
        several = len(away) + len(kafka) > 0
        if several:
            df.persist()
        try:
            if away:
                send_away(df, {h: endpoints[h] for h in away})
            for hook, e in kafka.items():
                part, others = df.filter(F.col("hook") == hook), endpoints[hook][1:]
                try:
                    _to_kafka(part, e)
                except (PySparkException, OSError) as x:
                    if not others and isinstance(x, AnalysisException):
                        raise  # Spark has no Kafka connector here: a fault of the set-up, not of the other side
                    _log.warning("hook %s: %s", hook, x)
                    if others:
                        send_away(part, {hook: others})
            for row in here.orderBy("seq").toLocalIterator():
                if row.hook not in endpoints:
                    sender.channels.publish(row.hook, row.message)
                else:
                    for _lost in send_rows([row], endpoints, sender, life, retry):
                        pass
        finally:
            if several:
                df.unpersist()

    return messages.writeStream.foreachBatch(batch)


def to_json(message: dict) -> str:
    return json.dumps(message, separators=(",", ":"), ensure_ascii=False)
