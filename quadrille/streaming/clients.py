"""Clients of message systems, in plain sockets and HTTP: one function (endpoint, message) a scheme.

Each returns once the system has said that it took the message, and raises OSError (`Refused` for an answer that says no)
otherwise. Connections stay open by URL, in the process that sends; a kept one that turns out dead is opened anew once, so
a message can arrive twice, never not at all. The option `api` of the HTTP systems names another base address, as of an
emulator. Kafka has no function here: its messages go through Spark's own writer (`kafka_options`).
"""

from __future__ import annotations

import base64
import configparser
import datetime as dt
import hashlib
import hmac
import json
import os
import socket
import ssl
import struct
import threading
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import quote, unquote_plus, urlencode, urlsplit

TIMEOUT = 10.0


class Refused(OSError):
    """The other side said no, or the URL lacks what the system needs."""


@dataclass
class Endpoint:
    scheme: str
    host: str = ""
    port: int | None = None
    path: str = ""
    options: dict[str, str] = field(default_factory=dict)
    url: str = ""

    def name(self, what: str) -> str:
        """The queue, topic or channel in the path."""
        found = unquote_plus(self.path.strip("/"))
        if not found:
            raise Refused(f"missing {what}")
        return found

    def flag(self, option: str, default: bool = False) -> bool:
        text = self.options.get(option)
        return default if text is None else text[:1].lower() in set("123456789yt")

    def number(self, option: str, default: int = 0) -> int:
        try:
            return int(self.options.get(option, default))
        except ValueError as e:
            raise Refused(f"invalid {option}") from e


# Connections.


class Link:
    """A socket that reads lines and exact lengths, with a place for what a protocol keeps."""

    def __init__(self, host: str, port: int):
        self.host, self.socket, self.rest, self.state = host, socket.create_connection((host, port), TIMEOUT), b"", {}

    def secure(self, options: dict[str, str], ca: str, cert: str, key: str) -> None:
        context = ssl.create_default_context(cafile=options.get(ca))
        if options.get(cert):
            context.load_cert_chain(options[cert], options.get(key))
        self.socket = context.wrap_socket(self.socket, server_hostname=self.host)

    def send(self, data: bytes) -> None:
        self.socket.sendall(data)

    def _more(self) -> None:
        data = self.socket.recv(65536)
        if not data:
            raise ConnectionError("connection closed")
        self.rest += data

    def take(self, n: int) -> bytes:
        while len(self.rest) < n:
            self._more()
        out, self.rest = self.rest[:n], self.rest[n:]
        return out

    def line(self) -> str:
        while b"\r\n" not in self.rest:
            self._more()
        out, self.rest = self.rest.split(b"\r\n", 1)
        return out.decode()

    def close(self) -> None:
        self.socket.close()


_links: dict[str, Link] = {}
_lock = threading.Lock()


def _over(e: Endpoint, port: int, greet: Callable[[Link], None], talk: Callable[[Link], None]) -> None:
    """Talk over the endpoint's kept link, or over a new one after greeting."""
    with _lock:
        kept = _links.pop(e.url, None)
    if kept:
        try:
            talk(kept)
        except Refused:
            kept.close()
            raise
        except OSError:
            kept.close()
            kept = None
    if not kept:
        kept = Link(e.host, e.port or port)
        try:
            greet(kept)
            talk(kept)
        except BaseException:
            kept.close()
            raise
    with _lock:
        old = _links.pop(e.url, None)
        _links[e.url] = kept
    if old:
        old.close()


def close_all() -> None:
    """Close every kept link of this process."""
    with _lock:
        for link in _links.values():
            link.close()
        _links.clear()


# Redis and Disque: arrays of byte strings, answers that begin with a letter of kind.


def _command(link: Link, *args: str) -> str:
    parts = [a.encode() for a in args]
    link.send(b"*%d\r\n" % len(parts) + b"".join(b"$%d\r\n%s\r\n" % (len(p), p) for p in parts))
    answer = link.line()
    if answer.startswith("-"):
        raise Refused(answer[1:])
    return answer


def redis(e: Endpoint, message: str) -> None:
    channel = unquote_plus(e.path.strip("/"))
    _over(e, 6379, lambda _: None, lambda link: _command(link, "PUBLISH", channel, message))


def disque(e: Endpoint, message: str) -> None:
    copies = e.number("replicate")
    args = ["ADDJOB", e.name("disque queue name"), message, "0", *(["REPLICATE", str(copies)] if copies else [])]
    _over(e, 7711, lambda _: None, lambda link: _command(link, *args))


# NATS: lines; a ping after each message shows that the server has read it.


def _nats_until(link: Link, wanted: str) -> str:
    while True:
        line = link.line()
        if line.startswith("-ERR"):
            raise Refused(line)
        if line == "PING":
            link.send(b"PONG\r\n")
        if line.split(" ")[0] == wanted:
            return line


def nats(e: Endpoint, message: str) -> None:
    topic, body = e.name("topic name"), message.encode()
    if "credential" in e.options:
        raise Refused("signed user credentials are not supported; use user and pass, or token")

    def greet(link: Link) -> None:
        _nats_until(link, "INFO")
        if e.flag("secure") or e.flag("tls"):
            link.secure(e.options, "tlsca", "tlscert", "tlskey")
        hello = {"verbose": False, "pedantic": False, "lang": "python", "version": "1"}
        if e.options.get("user") and e.options.get("pass"):
            hello |= {"user": e.options["user"], "pass": e.options["pass"]}
        if e.options.get("token"):
            hello["auth_token"] = e.options["token"]
        link.state["inbox"] = f"_INBOX.{uuid.uuid4().hex}"
        link.send(f"CONNECT {json.dumps(hello)}\r\nSUB {link.state['inbox']} 1\r\nPING\r\n".encode())
        _nats_until(link, "PONG")

    def talk(link: Link) -> None:
        if not e.flag("jetstream"):
            link.send(f"PUB {topic} {len(body)}\r\n".encode() + body + b"\r\nPING\r\n")
            _nats_until(link, "PONG")
            return
        link.send(f"PUB {topic} {link.state['inbox']} {len(body)}\r\n".encode() + body + b"\r\n")
        answer = json.loads(link.take(int(_nats_until(link, "MSG").split(" ")[-1])))
        link.take(2)
        if "error" in answer:
            raise Refused(json.dumps(answer["error"]))

    _over(e, 4222, greet, talk)


# MQTT 3.1.1.


def _mqtt_packet(kind: int, body: bytes) -> bytes:
    n, size = len(body), b""
    while True:
        n, low = divmod(n, 128)
        size += bytes([low | (128 if n else 0)])
        if not n:
            return bytes([kind]) + size + body


def _mqtt_read(link: Link) -> tuple[int, bytes]:
    kind, n, shift = link.take(1)[0], 0, 0
    while True:
        b = link.take(1)[0]
        n, shift = n | (b & 127) << shift, shift + 7
        if not b & 128:
            return kind >> 4, link.take(n)


def mqtt(e: Endpoint, message: str) -> None:
    topic, qos, retained = e.name("MQTT topic name").encode(), e.number("qos"), e.number("retained")
    if qos not in (0, 1, 2) or retained not in (0, 1):
        raise Refused("invalid MQTT qos or retained value")

    def greet(link: Link) -> None:
        if {"cacert", "cert", "key"} & set(e.options):
            link.secure(e.options, "cacert", "cert", "key")
        client = f"quadrille-{uuid.uuid4()}".encode()
        link.send(_mqtt_packet(0x10, b"\0\4MQTT\4\2\0\0" + struct.pack(">H", len(client)) + client))
        kind, body = _mqtt_read(link)
        if kind != 2 or body[1]:
            raise Refused(f"MQTT connection refused: {body.hex()}")

    def talk(link: Link) -> None:
        n = link.state["id"] = link.state.get("id", 0) % 65535 + 1
        number = struct.pack(">H", n)
        body = struct.pack(">H", len(topic)) + topic + (number if qos else b"") + message.encode()
        link.send(_mqtt_packet(0x30 | qos << 1 | retained, body))
        # Answers: 4 PUBACK for qos 1; 5 PUBREC, then 7 PUBCOMP after our PUBREL, for qos 2. For qos 0, that a ping (13) is answered.
        if qos == 0:
            link.send(_mqtt_packet(0xC0, b""))
        for wanted in ((13,), (4,), (5, 7))[qos]:
            kind, answer = _mqtt_read(link)
            if kind != wanted or (qos and answer[:2] != number):
                raise Refused(f"unexpected MQTT answer {kind}")
            if kind == 5:
                link.send(_mqtt_packet(0x62, number))

    _over(e, 1883, greet, talk)


# AMQP 0-9-1. Methods are (class, method) numbers.


def _short(text: str) -> bytes:
    data = text.encode()
    return bytes([len(data)]) + data


def _amqp_frame(kind: int, channel: int, body: bytes) -> bytes:
    return struct.pack(">BHI", kind, channel, len(body)) + body + b"\xce"


def _amqp_wait(link: Link, wanted: tuple[int, int]) -> bytes:
    refused = None
    while True:
        kind, _, size = struct.unpack(">BHI", link.take(7))
        body = link.take(size + 1)[:-1]
        if kind != 1:
            continue
        method = struct.unpack(">HH", body[:4])
        if method in ((10, 50), (20, 40)):  # connection or channel closed
            raise Refused(body[7 : 7 + body[6]].decode())
        if method == (60, 120):  # nack
            raise Refused("message not accepted")
        if method == (60, 50):  # returned: no queue takes it; its acknowledgement still follows
            refused = body[7 : 7 + body[6]].decode()
        if method == wanted:
            if refused:
                raise Refused(refused)
            return body[4:]


def _amqp_call(link: Link, channel: int, method: tuple[int, int], args: bytes, wanted: tuple[int, int]) -> bytes:
    link.send(_amqp_frame(1, channel, struct.pack(">HH", *method) + args))
    return _amqp_wait(link, wanted)


def _bits(*flags: bool) -> bytes:
    return bytes([sum(1 << i for i, f in enumerate(flags) if f)])


def amqp(e: Endpoint, message: str) -> None:
    """Publish to the exchange of the queue's name, which is made if it isn't there, with its queue and binding.

    The routing key, unless the option `route` names one, is the queue's name.
    """
    *space, queue = e.name("AMQP queue name").split("/")
    route, type_ = e.options.get("route") or queue, e.options.get("type", "direct")
    login = urlsplit(e.url)
    user, password = login.username or "guest", login.password or "guest"
    durable, auto = e.flag("durable", True), e.flag("auto_delete")
    head = b"\0\0" + _short(queue)
    table = b"\0\0\0\0"

    def greet(link: Link) -> None:
        if e.scheme == "amqps":
            link.secure(e.options, "cacert", "cert", "key")
        link.send(b"AMQP\0\0\x09\x01")
        _amqp_wait(link, (10, 10))
        proof = f"\0{unquote_plus(user)}\0{unquote_plus(password)}".encode()
        start = table + _short("PLAIN") + struct.pack(">I", len(proof)) + proof + _short("en_US")
        channels, frame, _ = struct.unpack(">HIH", _amqp_call(link, 0, (10, 11), start, (10, 30))[:8])
        link.state["frame"] = frame or 131072
        link.send(_amqp_frame(1, 0, struct.pack(">HHHIH", 10, 31, channels, link.state["frame"], 0)))
        _amqp_call(link, 0, (10, 40), _short("/".join(space) or "/") + b"\0\0", (10, 41))
        _amqp_call(link, 1, (20, 10), b"\0", (20, 11))
        _amqp_call(link, 1, (40, 10), head + _short(type_) + _bits(False, durable, auto, e.flag("internal"), False) + table, (40, 11))
        if type_ != "topic":
            _amqp_call(link, 1, (50, 10), head + _bits(False, durable, False, auto, False) + table, (50, 11))
            _amqp_call(link, 1, (50, 20), head + _short(queue) + _short(route) + b"\0" + table, (50, 21))
        _amqp_call(link, 1, (85, 10), b"\0", (85, 11))

    def talk(link: Link) -> None:
        body, room = message.encode(), link.state["frame"] - 8
        publish = struct.pack(">HH", 60, 40) + head + _short(route) + _bits(e.flag("mandatory"), e.flag("immediate"))
        # Properties: content type, delivery mode, priority.
        properties = struct.pack(">HHQH", 60, 0, len(body), 0x9800) + _short("application/json")
        properties += bytes([e.number("delivery_mode", 1), e.number("priority")])
        parts = [_amqp_frame(3, 1, body[i : i + room]) for i in range(0, len(body), room)]
        link.send(_amqp_frame(1, 1, publish) + _amqp_frame(2, 1, properties) + b"".join(parts))
        _amqp_wait(link, (60, 80))

    _over(e, 5672 if e.scheme == "amqp" else 5671, greet, talk)


# gRPC: one unary call over HTTP/2 without TLS. Frame types: 0 data, 1 headers, 3 reset, 4 settings, 6 ping, 7 go away, 8 window.

#: Fixed value of the service's definition: the path of its one method.
GRPC_PATH = "/hservice.HookService/Send"


def _h2_frame(kind: int, flags: int, stream: int, body: bytes = b"") -> bytes:
    return struct.pack(">I", len(body))[1:] + struct.pack(">BBI", kind, flags, stream) + body


def _prefixed(n: int, bits: int) -> bytes:
    """A number with a prefix of so many bits, as header compression has it."""
    most = (1 << bits) - 1
    if n < most:
        return bytes([n])
    out, n = bytes([most]), n - most
    while n >= 128:
        out, n = out + bytes([n % 128 | 128]), n // 128
    return out + bytes([n])


def _varint(n: int) -> bytes:
    out = b""
    while n >= 128:
        out, n = out + bytes([n % 128 | 128]), n // 128
    return out + bytes([n])


def grpc(e: Endpoint, message: str) -> None:
    """Call the hook service; taken if its reply holds ok = true."""
    headers = {
        ":method": "POST", ":scheme": "http", ":path": GRPC_PATH, ":authority": f"{e.host}:{e.port or 80}",
        "content-type": "application/grpc", "te": "trailers",
    }
    text = lambda s: _prefixed(len(s.encode()), 7) + s.encode()
    block = b"".join(b"\0" + text(k) + text(v) for k, v in headers.items())
    value = message.encode()
    body = b"\x0a" + _varint(len(value)) + value
    body = b"\0" + struct.pack(">I", len(body)) + body

    def greet(link: Link) -> None:
        link.send(b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n" + _h2_frame(4, 0, 0))
        link.state |= {"stream": -1, "window": 65535, "initial": 65535, "frame": 16384}

    def talk(link: Link) -> None:
        s = link.state
        s["stream"] += 2
        stream, own, sent, reply = s["stream"], s["initial"], 0, b""
        link.send(_h2_frame(1, 4, stream, block))
        while True:
            while sent < len(body) and (room := min(own, s["window"], s["frame"], len(body) - sent)) > 0:
                last = sent + room == len(body)
                link.send(_h2_frame(0, int(last), stream, body[sent : sent + room]))
                sent, own, s["window"] = sent + room, own - room, s["window"] - room
            head = link.take(9)
            size, kind, flags, at = int.from_bytes(head[:3], "big"), head[3], head[4], int.from_bytes(head[5:], "big") & 0x7FFFFFFF
            data = link.take(size)
            if kind == 4 and not flags & 1:
                for i in range(0, size, 6):
                    name, v = struct.unpack(">HI", data[i : i + 6])
                    if name == 4:
                        own, s["initial"] = own + v - s["initial"], v
                    elif name == 5:
                        s["frame"] = v
                link.send(_h2_frame(4, 1, 0))
            elif kind == 6 and not flags & 1:
                link.send(_h2_frame(6, 1, 0, data))
            elif kind == 8:
                more = int.from_bytes(data, "big") & 0x7FFFFFFF
                s["window"], own = s["window"] + more * (at == 0), own + more * (at == stream)
            elif kind == 7:
                raise ConnectionError("the service goes away")
            elif at == stream and kind == 3:
                raise Refused("call reset by the service")
            elif at == stream and kind in (0, 1):
                if kind == 0:
                    reply += data[1 : size - data[0]] if flags & 8 else data
                    if size:
                        link.send(_h2_frame(8, 0, 0, struct.pack(">I", size)))
                if flags & 1:
                    # A reply is five bytes of frame, then field 1 as a number.
                    if reply[5:7] != b"\x08\x01":
                        raise Refused("the service did not answer ok")
                    return

    _over(e, 80, greet, talk)


# HTTP.


def _post(url: str, body: bytes, headers: dict[str, str]) -> bytes:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=TIMEOUT) as response:
            if response.status >= 300:
                raise Refused(f"status {response.status}")
            return response.read()
    except urllib.error.HTTPError as x:
        raise Refused(f"status {x.code}: {x.read()[:200]!r}") from x


def http(e: Endpoint, message: str) -> None:
    _post(e.url, message.encode(), {"Content-Type": "application/json"})


def _about(message: str) -> tuple[str, str]:
    """Key and id of the object that a message tells of."""
    try:
        own = json.loads(message)
    except ValueError:
        return "", ""
    return (str(own.get("key", "")), str(own.get("id", ""))) if isinstance(own, dict) else ("", "")


def cf_queue(e: Endpoint, message: str) -> None:
    queue, token = e.name("queue ID"), e.options.get("token")
    if not token:
        raise Refused("missing API token")
    base = e.options.get("api", "https://api.cloudflare.com/client/v4")
    body = json.dumps({"body": message, "content_type": "text"}).encode()
    _post(f"{base}/accounts/{e.host}/queues/{queue}/messages", body, {"Content-Type": "application/json", "Authorization": f"Bearer {token}"})


def eventhub(e: Endpoint, message: str) -> None:
    o = e.options
    for need in ("Endpoint", "SharedAccessKeyName", "SharedAccessKey", "EntityPath"):
        if need not in o:
            raise Refused(f"missing {need}")
    target = f"https://{urlsplit(o['Endpoint']).netloc}/{o['EntityPath']}"
    ends, name = str(int(time.time()) + 3600), quote(target, safe="")
    proof = base64.b64encode(hmac.new(o["SharedAccessKey"].encode(), f"{name}\n{ends}".encode(), hashlib.sha256).digest()).decode()
    token = f"SharedAccessSignature sr={name}&sig={quote(proof, safe='')}&se={ends}&skn={o['SharedAccessKeyName']}"
    headers = {"Authorization": token, "Content-Type": "application/json", "BrokerProperties": json.dumps({"PartitionKey": "-".join(_about(message))})}
    _post(f"{o.get('api', target)}/messages", message.encode(), headers)


def _aws_keys(o: dict[str, str]) -> tuple[str, str, str | None]:
    path = o.get("credpath") or os.path.expanduser("~/.aws/credentials")
    if not o.get("credpath") and os.environ.get("AWS_ACCESS_KEY_ID"):
        return os.environ["AWS_ACCESS_KEY_ID"], os.environ.get("AWS_SECRET_ACCESS_KEY", ""), os.environ.get("AWS_SESSION_TOKEN")
    ini = configparser.ConfigParser(interpolation=None)
    ini.read(path)
    profile = o.get("credprofile", "default")
    if not ini.has_option(profile, "aws_access_key_id"):
        raise Refused(f"no credentials for profile {profile}")
    own = ini[profile]
    return own["aws_access_key_id"], own.get("aws_secret_access_key", ""), own.get("aws_session_token")


def signed(url: str, body: bytes, region: str, service: str, keys: tuple[str, str, str | None], now: dt.datetime) -> dict[str, str]:
    """Headers of a form POST signed with version 4 of the AWS scheme."""
    day, at = now.strftime("%Y%m%d"), now.strftime("%Y%m%dT%H%M%SZ")
    parts = urlsplit(url)
    headers = {"content-type": "application/x-www-form-urlencoded", "host": parts.netloc, "x-amz-date": at}
    if keys[2]:
        headers["x-amz-security-token"] = keys[2]
    names = ";".join(sorted(headers))
    lines = "".join(f"{k}:{headers[k]}\n" for k in sorted(headers))
    request = "\n".join(["POST", quote(parts.path or "/"), "", lines, names, hashlib.sha256(body).hexdigest()])
    scope = f"{day}/{region}/{service}/aws4_request"
    text = f"AWS4-HMAC-SHA256\n{at}\n{scope}\n{hashlib.sha256(request.encode()).hexdigest()}"
    key = ("AWS4" + keys[1]).encode()
    for part in (day, region, service, "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    proof = hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
    own = {k: v for k, v in headers.items() if k != "host"}
    return own | {"Authorization": f"AWS4-HMAC-SHA256 Credential={keys[0]}/{scope}, SignedHeaders={names}, Signature={proof}"}


def sqs(e: Endpoint, message: str) -> None:
    """sqs://region:account/queue, or the queue's own https address."""
    if e.scheme == "sqs" and e.url.startswith("https:"):
        region, target = e.host.split(".")[1], e.url.split("?")[0]
    else:
        region, _, account = e.host.partition(":")
        base = e.options.get("api", f"https://sqs.{region}.amazonaws.com")
        target = f"{base}/{account}/{e.name('SQS queue name')}"
    keys = _aws_keys(e.options)

    def ask(url: str, form: dict[str, str]) -> None:
        body = urlencode(form | {"Version": "2012-11-05"}).encode()
        _post(url, body, signed(url, body, region, "sqs", keys, dt.datetime.now(dt.UTC)))

    if e.options.get("createqueue", "false").lower() not in ("0", "false"):
        # The delay and life of messages in a queue made so.
        form = {"Action": "CreateQueue", "QueueName": target.rsplit("/", 1)[1]}
        form |= {"Attribute.1.Name": "DelaySeconds", "Attribute.1.Value": "60", "Attribute.2.Name": "MessageRetentionPeriod", "Attribute.2.Value": "86400"}
        ask(target.rsplit("/", 2)[0] + "/", form)
    fifo = {"MessageGroupId": "#".join(_about(message))} if target.endswith(".fifo") else {}
    ask(target, {"Action": "SendMessage", "MessageBody": message} | fifo)


def _der(data: bytes, at: int = 0) -> tuple[int, bytes, int]:
    """Tag, content and end of the element at a place."""
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 128:
        n, at = int.from_bytes(data[at : at + (n & 127)], "big"), at + (n & 127)
    return tag, data[at : at + n], at + n


def _elements(data: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(data):
        tag, content, at = _der(data, at)
        out.append((tag, content))
    return out


def rs256(pem: str, text: bytes) -> bytes:
    """An RSA signature over SHA-256 by a private key in PKCS #8 or PKCS #1 form."""
    data = base64.b64decode("".join(line for line in pem.splitlines() if not line.startswith("-")))
    parts = _elements(_der(data)[1])
    if parts[1][0] == 0x30:  # the key itself lies in an octet string
        parts = _elements(_der(parts[2][1])[1])
    n, _, d = (int.from_bytes(c, "big") for _, c in parts[1:4])
    size = (n.bit_length() + 7) // 8
    # Fixed value: how a SHA-256 digest is announced.
    digest = bytes.fromhex("3031300d060960864801650304020105000420") + hashlib.sha256(text).digest()
    padded = b"\0\1" + b"\xff" * (size - len(digest) - 3) + b"\0" + digest
    return pow(int.from_bytes(padded, "big"), d, n).to_bytes(size, "big")


_tokens: dict[str, tuple[float, str]] = {}


def _google_token(path: str) -> str:
    ends, token = _tokens.get(path, (0.0, ""))
    if ends > time.time() + 60:
        return token
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    now = int(time.time())
    claim = {"iss": own["client_email"], "scope": "https://www.googleapis.com/auth/pubsub", "aud": own["token_uri"], "iat": now, "exp": now + 3600}
    packed = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=")
    text = packed(b'{"alg":"RS256","typ":"JWT"}') + b"." + packed(json.dumps(claim).encode())
    proof = text + b"." + packed(rs256(own["private_key"], text))
    form = urlencode({"grant_type": "urn:ietf:params:oauth:grant-type:jwt-bearer", "assertion": proof.decode()}).encode()
    answer = json.loads(_post(own["token_uri"], form, {"Content-Type": "application/x-www-form-urlencoded"}))
    _tokens[path] = (now + answer.get("expires_in", 3600), answer["access_token"])
    return answer["access_token"]


def pubsub(e: Endpoint, message: str) -> None:
    """pubsub://project:topic with `credpath`, a service account's file; without it only an emulator (`api`) answers."""
    project, _, topic = e.host.partition(":")
    if not topic:
        raise Refused("invalid address, should be project:topic")
    path = e.options.get("credpath") or os.environ.get("GOOGLE_APPLICATION_CREDENTIALS")
    if not path and "api" not in e.options:
        raise Refused("missing credpath")
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {_google_token(path)}"} if path else {})
    body = json.dumps({"messages": [{"data": base64.b64encode(message.encode()).decode()}]}).encode()
    _post(f"{e.options.get('api', 'https://pubsub.googleapis.com')}/v1/projects/{project}/topics/{topic}:publish", body, headers)


def _text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def kafka_options(e: Endpoint) -> dict[str, str]:
    """Options of Spark's Kafka writer for an endpoint.

    `auth` is none, tls, or sasl with the user and password in KAFKA_USERNAME and KAFKA_PASSWORD; `sha256` and `sha512`
    choose the mechanism; `ssl`, `cacert`, `cert` and `key` are as usual. Files are read here, so only the driver needs them.
    """
    o, out = e.options, {"kafka.bootstrap.servers": f"{e.host}:{e.port or 9092}", "topic": e.name("kafka topic name")}
    sasl, tls = o.get("auth") == "sasl", e.flag("ssl") or o.get("auth") == "tls"
    out["kafka.security.protocol"] = ("SASL_" if sasl else "") + ("SSL" if tls else "PLAINTEXT")
    if sasl:
        mechanism = "SCRAM-SHA-512" if e.flag("sha512") else "SCRAM-SHA-256" if e.flag("sha256") else "PLAIN"
        module = "plain.PlainLoginModule" if mechanism == "PLAIN" else "scram.ScramLoginModule"
        user, password = (json.dumps(os.environ.get(n, "")) for n in ("KAFKA_USERNAME", "KAFKA_PASSWORD"))
        out["kafka.sasl.mechanism"] = mechanism
        out["kafka.sasl.jaas.config"] = f"org.apache.kafka.common.security.{module} required username={user} password={password};"
    if tls and o.get("cacert"):
        out |= {"kafka.ssl.truststore.type": "PEM", "kafka.ssl.truststore.certificates": _text(o["cacert"])}
    if o.get("auth") == "tls":
        chain, key = _text(o.get("cert", "")), _text(o.get("key", ""))
        out |= {"kafka.ssl.keystore.type": "PEM", "kafka.ssl.keystore.certificate.chain": chain, "kafka.ssl.keystore.key": key}
    return out


#: Scheme -> function. Kafka isn't here, and neither are local channels, which live in a process.
SENDERS: dict[str, Callable[[Endpoint, str], None]] = {
    "http": http, "https": http, "redis": redis, "disque": disque, "nats": nats, "mqtt": mqtt, "amqp": amqp, "amqps": amqp,
    "grpc": grpc, "sqs": sqs, "pubsub": pubsub, "eventhub": eventhub, "cf-queue": cf_queue,
}
