"""Clients of message systems against small servers that parse what they get, and delivery with retries."""

import base64
import contextlib
import datetime as dt
import http.server
import json
import shutil
import socket
import struct
import subprocess
import threading
import time

import pytest

from quadrille.engine import Engine
from quadrille.streaming import clients, sinks

TEXT = '{"key":"fleet","id":"truck é","n":1}'


@contextlib.contextmanager
def served(handle):
    """The port of a server that gives each connection's file and socket to `handle`."""
    server = socket.create_server(("127.0.0.1", 0))

    def loop():
        while True:
            try:
                link, _ = server.accept()
            except OSError:
                return
            threading.Thread(target=one, args=(link,), daemon=True).start()

    def one(link):
        with contextlib.suppress(OSError, ValueError, IndexError, struct.error), link, link.makefile("rb") as f:
            handle(f, link)

    threading.Thread(target=loop, daemon=True).start()
    try:
        yield server.getsockname()[1]
    finally:
        server.close()
        clients.close_all()


def post(url, message=TEXT):
    e = sinks.parse_endpoint(url)
    clients.SENDERS[e.scheme](e, message)


def test_redis_and_disque():
    got = []

    def handle(f, link):
        while head := f.readline():
            args = []
            for _ in range(int(head[1:])):
                n = int(f.readline()[1:])
                args.append(f.read(n + 2)[:-2].decode())
            got.append(args)
            link.sendall(b"-ERR no\r\n" if args[1] == "bad" else b":1\r\n" if args[0] == "PUBLISH" else b"+D-1\r\n")

    with served(handle) as port:
        post(f"redis://127.0.0.1:{port}/my+chan")
        post(f"redis://127.0.0.1:{port}/my+chan", "")
        post(f"disque://127.0.0.1:{port}/q?replicate=2")
        with pytest.raises(clients.Refused, match="ERR no"):
            post(f"redis://127.0.0.1:{port}/bad")
        with pytest.raises(clients.Refused, match="missing disque"):
            post(f"disque://127.0.0.1:{port}/")
    wanted = [["PUBLISH", "my chan", TEXT], ["PUBLISH", "my chan", ""], ["ADDJOB", "q", TEXT, "0", "REPLICATE", "2"], ["PUBLISH", "bad", TEXT]]
    assert got == wanted


def test_dead_link_is_opened_anew():
    got = []

    def handle(f, link):
        for _ in range(3):
            f.readline()
        f.readline()
        got.append(f.readline())
        for _ in range(2):
            f.readline()
        link.sendall(b":1\r\n")  # then it hangs up

    with served(handle) as port:
        for _ in range(3):
            post(f"redis://127.0.0.1:{port}/c")
            time.sleep(0.1)
    assert got == [b"c\r\n"] * 3


def test_nats():
    got = []

    def handle(f, link):
        link.sendall(b'INFO {"server_id":"x"}\r\n')
        while line := f.readline().decode().split():
            if line[0] == "CONNECT":
                got.append(json.loads(" ".join(line[1:])).get("user"))
            elif line[0] == "PING":
                link.sendall(b"PING\r\nPONG\r\n")
            elif line[0] == "PUB":
                body = f.read(int(line[-1]) + 2)[:-2].decode()
                got.append((line[1], body))
                if line[1] == "bad":
                    link.sendall(b"-ERR 'Permissions Violation'\r\n")
                elif len(line) == 4:
                    answer = b'{"error":{"code":1}}' if line[1] == "full" else b'{"stream":"s","seq":1}'
                    link.sendall(f"MSG {line[2]} 1 {len(answer)}\r\n".encode() + answer + b"\r\n")

    with served(handle) as port:
        base = f"nats://127.0.0.1:{port}"
        post(f"{base}/t?user=u&pass=p")
        post(f"{base}/t?user=u&pass=p", "b")
        post(f"{base}/s?jetstream=true")
        for bad in ("bad", "full?jetstream=1"):
            with pytest.raises(clients.Refused):
                post(f"{base}/{bad}")
    assert got == ["u", ("t", TEXT), ("t", "b"), None, ("s", TEXT), None, ("bad", TEXT), None, ("full", TEXT)]


def test_mqtt():
    got = []

    def handle(f, link):
        while head := f.read(1):
            n = shift = 0
            while True:
                b = f.read(1)[0]
                n, shift = n + ((b & 127) << shift), shift + 7
                if b < 128:
                    break
            kind, body = head[0] >> 4, f.read(n)
            if kind == 1:
                assert body[:7] == b"\0\4MQTT\4"
                link.sendall(b"\x20\2\0\0")
            elif kind == 3:
                size, qos = struct.unpack(">H", body[:2])[0], head[0] >> 1 & 3
                rest = body[2 + size :]
                got.append((body[2 : 2 + size].decode(), qos, head[0] & 1, rest[2 * (qos > 0) :].decode()))
                if qos:
                    link.sendall(bytes([0x40 if qos == 1 else 0x50, 2]) + rest[:2])
            elif kind == 6:
                link.sendall(b"\x70\2" + body)
            elif kind == 12:
                link.sendall(b"\xd0\0")

    long = "é" * 20_000
    with served(handle) as port:
        for q in ("", "?qos=1", "?qos=2&retained=1"):
            post(f"mqtt://127.0.0.1:{port}/a/b{q}")
        post(f"mqtt://127.0.0.1:{port}/a/b?qos=2&retained=1", long)
        with pytest.raises(clients.Refused):
            post(f"mqtt://127.0.0.1:{port}/a?qos=5")
    assert got == [("a/b", 0, 0, TEXT), ("a/b", 1, 0, TEXT), ("a/b", 2, 1, TEXT), ("a/b", 2, 1, long)]


def test_amqp():
    got = []

    def handle(f, link):
        assert f.read(8) == b"AMQP\0\0\x09\x01"

        def tell(channel, method, args=b""):
            body = struct.pack(">HH", *method) + args
            link.sendall(struct.pack(">BHI", 1, channel, len(body)) + body + b"\xce")

        tell(0, (10, 10), b"\0\x09\0\0\0\0" + b"\0\0\0\5PLAIN" + b"\0\0\0\5en_US")
        answers = {(10, 11): ((10, 30), struct.pack(">HIH", 10, 4096, 60)), (10, 40): ((10, 41), b"\0"), (20, 10): ((20, 11), b"\0\0\0\0")}
        answers |= {(40, 10): ((40, 11), b""), (50, 10): ((50, 11), b"\1q\0\0\0\0\0\0\0\0"), (50, 20): ((50, 21), b""), (85, 10): ((85, 11), b"")}
        size, text, number = 0, b"", 0
        while head := f.read(7):
            kind, channel, n = struct.unpack(">BHI", head)
            body = f.read(n)
            assert f.read(1) == b"\xce" and n <= 4096 - 8
            if kind == 1:
                method, args = struct.unpack(">HH", body[:4]), body[4:]
                got.append((method, args))
                if method == (40, 10) and b"forbidden" in args:
                    tell(channel, (20, 40), struct.pack(">H", 403) + b"\x06denied" + b"\0\0\0\0")
                elif method in answers:
                    tell(channel, *answers[method])
            elif kind == 2:
                size, text = struct.unpack(">Q", body[4:12])[0], b""
                got.append(("properties", body[12:]))
            else:
                text += body
                if len(text) == size:
                    number += 1
                    got.append(("text", text.decode()))
                    tell(channel, (60, 80), struct.pack(">QB", number, 0))

    long = "x" * 10_000
    with served(handle) as port:
        post(f"amqp://me:pw@127.0.0.1:{port}/space/q?route=r&delivery_mode=2&priority=3")
        post(f"amqp://me:pw@127.0.0.1:{port}/space/q?route=r&delivery_mode=2&priority=3", long)
        with pytest.raises(clients.Refused, match="denied"):
            post(f"amqp://127.0.0.1:{port}/forbidden")
    sent = dict(got[:8])
    assert b"\0me\0pw" in sent[10, 11] and sent[10, 40] == b"\x05space\0\0"
    assert sent[40, 10] == b"\0\0\1q\6direct\2\0\0\0\0" and sent[50, 10] == b"\0\0\1q\2\0\0\0\0" and sent[50, 20] == b"\0\0\1q\1q\1r\0\0\0\0\0"
    assert ((60, 40), b"\0\0\1q\1r\0") in got and ("properties", b"\x98\0\x10application/json\2\3") in got
    assert [t for k, t in got if k == "text"] == [TEXT, long]


def test_grpc():
    got = []

    def handle(f, link):
        def frame(kind, flags, stream, body=b""):
            link.sendall(len(body).to_bytes(3, "big") + struct.pack(">BBI", kind, flags, stream) + body)

        assert f.read(24) == b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"
        frame(4, 0, 0, struct.pack(">HI", 4, 30_000))
        bodies = {}
        while head := f.read(9):
            n, kind, flags, stream = int.from_bytes(head[:3], "big"), head[3], head[4], int.from_bytes(head[5:], "big")
            body = f.read(n)
            if kind == 1:
                assert b"/hservice.HookService/Send" in body and flags & 4
                bodies[stream] = b""
            elif kind == 0:
                bodies[stream] += body
                if n:
                    frame(8, 0, 0, struct.pack(">I", n))
                    frame(8, 0, stream, struct.pack(">I", n))
                if flags & 1:
                    text = bodies[stream]
                    assert struct.unpack(">I", text[1:5])[0] == len(text) - 5 and text[5] == 0x0A
                    at = 6
                    while text[at] & 128:
                        at += 1
                    got.append(text[at + 1 :].decode())
                    frame(6, 0, 0, b"12345678")
                    frame(1, 4, stream, b"\x88")
                    frame(0, 0, stream, b"\0\0\0\0\0" if got[-1] == "no" else b"\0\0\0\0\2\x08\1")
                    frame(1, 5, stream, b"\0\x0bgrpc-status\x010")

    long = "é" * 100_000
    with served(handle) as port:
        for text in (TEXT, long, TEXT):
            post(f"grpc://127.0.0.1:{port}", text)
        with pytest.raises(clients.Refused):
            post(f"grpc://127.0.0.1:{port}", "no")
    assert got == [TEXT, long, TEXT, "no"]


@pytest.fixture
def web():
    """(address, requests as (path, headers, body)) of a web server that turns down paths with `down`."""
    got = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            got.append((self.path, dict(self.headers), body))
            self.send_response(503 if "down" in self.path else 200)
            self.end_headers()
            self.wfile.write(b'{"access_token":"T","expires_in":3600}')

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", got
    server.shutdown()


def test_web_queues(web, tmp_path):
    base, got = web
    post(f"{base}/hook")
    with pytest.raises(clients.Refused):
        post(f"{base}/down")
    post(f"cf-queue://Acc/Que?token=t&api={base}")
    assert got[2][0] == "/accounts/Acc/queues/Que/messages" and got[2][1]["Authorization"] == "Bearer t" and json.loads(got[2][2])["body"] == TEXT
    post(f"Endpoint=sb://ns.example.net/;SharedAccessKeyName=n;SharedAccessKey=k=;EntityPath=hub;api={base}/hub")
    path, headers, body = got[3]
    assert path == "/hub/messages" and body == TEXT and json.loads(headers["Brokerproperties"]) == {"PartitionKey": "fleet-truck é"}
    assert headers["Authorization"].startswith("SharedAccessSignature sr=https%3A%2F%2Fns.example.net%2Fhub&sig=")
    (tmp_path / "aws").write_text("[p]\naws_access_key_id = A\naws_secret_access_key = S\n")
    post(f"sqs://eu-west-1:123456789012/q.fifo?credpath={tmp_path}/aws&credprofile=p&createqueue=1&api={base}")
    assert got[4][0] == "/" and "Action=CreateQueue&QueueName=q.fifo" in got[4][2]
    assert got[5][0] == "/123456789012/q.fifo" and "MessageGroupId=fleet%23truck+%C3%A9" in got[5][2] and "/eu-west-1/sqs/" in got[5][1]["Authorization"]
    post(f"pubsub://proj:top?api={base}")
    assert got[6][0] == "/v1/projects/proj/topics/top:publish"
    assert base64.b64decode(json.loads(got[6][2])["messages"][0]["data"]).decode() == TEXT
    for bad in ("pubsub://proj", "cf-queue://a/b", "sqs://r:1/", f"sqs://r:1/q?credpath={tmp_path}/none"):
        with pytest.raises(clients.Refused):
            post(bad)


def test_signatures(web, tmp_path):
    # A published example of the signing scheme.
    keys, now = ("AKIDEXAMPLE", "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY", None), dt.datetime(2015, 8, 30, 12, 36)
    headers = clients.signed("https://example.amazonaws.com/", b"Param1=value1", "us-east-1", "service", keys, now)
    assert headers["Authorization"].endswith("Signature=ff11897932ad3f4e8b18135d722051e5ac45fc38421b1da7b9d196a0fe09473a")
    if not shutil.which("openssl"):
        pytest.skip("no openssl to make a key")
    base, got = web
    pem = subprocess.run(["openssl", "genpkey", "-algorithm", "RSA", "-pkeyopt", "rsa_keygen_bits:2048"], capture_output=True, check=True).stdout
    (tmp_path / "k.pem").write_bytes(pem)
    subprocess.run(["openssl", "pkey", "-in", f"{tmp_path}/k.pem", "-pubout", "-out", f"{tmp_path}/p.pem"], check=True)
    (tmp_path / "t").write_bytes(b"text")
    (tmp_path / "s").write_bytes(clients.rs256(pem.decode(), b"text"))
    subprocess.run(["openssl", "dgst", "-sha256", "-verify", f"{tmp_path}/p.pem", "-signature", f"{tmp_path}/s", f"{tmp_path}/t"], check=True)
    (tmp_path / "c.json").write_text(json.dumps({"client_email": "a@b", "token_uri": f"{base}/token", "private_key": pem.decode()}))
    for _ in range(2):
        post(f"pubsub://proj:top?credpath={tmp_path}/c.json&api={base}")
    assert [g[0] for g in got] == ["/token", *["/v1/projects/proj/topics/top:publish"] * 2] and got[2][1]["Authorization"] == "Bearer T"


def test_kafka_options(monkeypatch, tmp_path):
    monkeypatch.setenv("KAFKA_USERNAME", "u")
    monkeypatch.setenv("KAFKA_PASSWORD", 'p"')
    assert clients.kafka_options(sinks.parse_endpoint("kafka://h/t")) == {
        "kafka.bootstrap.servers": "h:9092", "topic": "t", "kafka.security.protocol": "PLAINTEXT"
    }
    (tmp_path / "ca").write_text("CA")
    o = clients.kafka_options(sinks.parse_endpoint(f"kafka://h:1/t?auth=sasl&ssl=true&sha512=true&cacert={tmp_path}/ca"))
    assert o["kafka.security.protocol"] == "SASL_SSL" and o["kafka.sasl.mechanism"] == "SCRAM-SHA-512"
    assert 'username="u" password="p\\""' in o["kafka.sasl.jaas.config"] and o["kafka.ssl.truststore.certificates"] == "CA"
    with pytest.raises(clients.Refused):
        clients.kafka_options(sinks.parse_endpoint("kafka://h"))


def test_delivery_by_executors(spark, web, tmp_path):
    """Each hook's messages in order; failover; a dead hook is given up and holds back no other; no batch runs twice."""
    base, got = web
    rows = [(h, "k", str(i), i, "enter", f"{h}:{i}") for i in range(40) for h in ("good", "spare", "dead")]
    spark.createDataFrame(rows, "hook string, key string, id string, seq long, detect string, message string").coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    where = {"good": [f"{base}/good"], "spare": [f"{base}/down", f"{base}/spare"], "dead": [f"{base}/down"], "unused": ["kafka://h/t", f"{base}/x"]}
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    stream = sinks.deliver(source, where, sinks.Sender(), life=0.5, retry=0.1).option("checkpointLocation", f"{tmp_path}/c")
    stream.trigger(availableNow=True).start().awaitTermination(120)
    for hook in ("good", "spare"):
        assert [body for path, _, body in got if path == f"/{hook}"] == [f"{hook}:{i}" for i in range(40)]
    assert {body for path, _, body in got if path == "/down"} == {f"{h}:{i}" for i in range(40) for h in ("spare", "dead")}


def test_retry_until_it_works():
    tries = []

    def flaky(e, m):
        tries.append(m)
        if len(tries) < 3:
            raise OSError("down")

    Row = type("Row", (), {})
    rows = []
    for i in range(2):
        r = Row()
        r.hook, r.seq, r.message = "h", i, f"m{i}"
        rows.append(r)
    assert list(sinks.send_rows(rows, {"h": ["nats://x/t"]}, sinks.Sender(senders={"nats": flaky}), life=5, retry=0.01)) == []
    assert tries == ["m0", "m0", "m0", "m1"]


def test_subscriptions_and_info(spark):
    e = Engine(spark)
    assert e.execute("SUBSCRIBE news gate")["channels"] == ["news", "gate"] and e.execute("PSUBSCRIBE n*")["patterns"] == ["n*"]
    e.execute("PUBLISH news hello")
    e.execute("PUBLISH other hello")
    assert e.inbox == [("news", "hello")] * 2
    e.execute("SETCHAN gate WITHIN cars FENCE DETECT enter BOUNDS 0 0 10 10")
    e.execute("SET cars a POINT 5 5")
    e.execute("SET cars b STRING text")
    assert e.inbox[2][0] == "gate" and json.loads(e.inbox[2][1])["detect"] == "enter"
    info = e.execute("INFO")["info"]
    assert info["keyspace"]["num_objects"] == 2 and info["keyspace"]["num_strings"] == 1 and info["stats"]["num_hooks"] == 1
    assert list(e.execute("INFO stats nothing")["info"]) == ["stats"]
