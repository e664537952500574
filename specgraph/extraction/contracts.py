"""Contract facts of one file: who produces, consumes, owns or shares what, and with which payload.

A fact is a dict of FACT's columns. Every reader takes (file, found) and appends; readers of a language run over files of that language only.
"""

from __future__ import annotations

import ast
import json
import re
from dataclasses import dataclass
from itertools import pairwise

from specgraph.extraction.parse import SCRIPT, containing, methods, parse, source_of
from specgraph.extraction.source import Source, constants, members, string, value
from specgraph.operators.impact import http_key

FACT = "repo_id string, file_id string, path string, kind string, key string, name string, role string, line int, raw string, rule string, confidence double, spec_kind string, spec string, framework string, symbol string, refs array<string>"
NAMES = [x.split()[0] for x in FACT.split(", ")]

# How far each kind of evidence is trusted.
MANIFEST, ANNOTATION, ROUTE, CLIENT, PROBABLE_ROUTE, EVENT, SHARED, FIELDS, CONFIG_FILE, CONFIG_REF, UNKNOWN_METHOD, PACKAGE_PATH, IMPORT, REGEX_ROUTE = 1.0, 0.9, 0.9, 0.85, 0.8, 0.85, 0.75, 0.75, 0.75, 0.7, 0.6, 0.8, 0.9, 0.85
# Pieces of module names that give a messaging library away, in the order in which they are tried.
BROKERS = (
    ("kafka", ("kafka", "@nestjs/microservices", "shopify/sarama", "/sarama")), ("rabbitmq", ("amqplib", "amqp-connection-manager", "pika", "amqp091", "org.springframework.amqp", "com.rabbitmq")),
    ("redis-stream", ("ioredis", "go-redis", "redis")), ("nats", ("nats",)),
)
HTTP_VERBS = ("get", "post", "put", "patch", "delete", "head", "options")


@dataclass
class File:
    repo_id: str
    file_id: str
    path: str
    language: str
    text: str

    @property
    def parsed(self) -> dict:
        return parse(self.text, self.language, self.path)

    @property
    def source(self) -> Source:
        return source_of(self.text, self.language)


def fact(file: File, kind: str, key: str, role: str, line: int, raw: str, rule: str, confidence: float, name: str = "", spec: dict | None = None, framework: str | None = None, symbol: str | None = None, refs: list[str] = ()) -> dict:
    return {
        "repo_id": file.repo_id, "file_id": file.file_id, "path": file.path, "kind": kind, "key": key, "name": name or key, "role": role, "line": line, "raw": raw, "rule": rule, "confidence": confidence,
        "spec_kind": spec["kind"] if spec else None, "spec": json.dumps({k: v for k, v in spec.items() if v is not None}, ensure_ascii=False) if spec else None, "framework": framework, "symbol": symbol, "refs": list(refs),
    }


def audit(file: File, line: int, raw: str, rule: str, reason: str) -> dict:
    """Evidence without a contract, of no confidence: what couldn't be resolved, and why."""
    return fact(file, "", "", "", line, f"{raw} // unresolved: {reason}", rule, 0.0)


def api(file: File, path: str, role: str, line: int, raw: str, rule: str, confidence: float, method: str | None = None, framework: str | None = None, request: str | None = None, response: str | None = None) -> dict:
    key = http_key(path, method)
    template = re.sub(r"^[A-Z]+:", "", key)
    spec = {"kind": "http-endpoint", "method": method, "path": path, "pathTemplate": template, "pathParams": re.findall(r"\{([^}]+)\}", template), "requestBodyType": request, "responseBodyType": response, "auth": "unknown"}
    inside = containing(file.parsed["symbols"], line)
    return fact(file, "api", key, role, line, raw, rule, confidence, f"HTTP API {path}", spec, framework, inside and inside["qualified_name"])


def event(file: File, topic: str, role: str, line: int, raw: str, rule: str, confidence: float, broker: str, payload: str | None = None, framework: str | None = None) -> dict:
    spec = {"kind": "event", "topic": topic, "payloadType": payload, "broker": broker}
    return fact(file, "event", topic.strip().lower(), role, line, raw, rule, confidence, topic, spec, framework or (broker if broker != "unknown" else None))


def grpc(file: File, package: str, service: str, method: str, role: str, line: int, raw: str, rule: str, confidence: float, request: str | None = None, response: str | None = None, streaming: str = "unary", framework: str = "") -> dict:
    full = f"{package}.{service}/{method}" if package else f"{service}/{method}"
    key = f"{package.lower()}.{service}/{method}" if package else full
    spec = {"kind": "grpc-method", "service": service, "method": method, "package": package or None, "fullName": full, "requestType": request, "responseType": response, "streaming": streaming, "framework": framework}
    return fact(file, "grpc", key, role, line, raw, rule, confidence, full, spec, framework)


def dubbo(file: File, interface: str, method: str, role: str, line: int, raw: str, rule: str, group: str | None, version: str | None, config: str, requests: list[str] = (), response: str | None = None) -> dict:
    face = re.sub(r"\s+", "", interface)
    spec = {"kind": "dubbo-method", "interfaceName": face, "method": method, "group": group, "version": version, "fullName": f"{face}#{method}", "requestTypes": list(requests) or None, "responseType": response, "config": config}
    return fact(file, "dubbo", f"{face.lower()}#{method}", role, line, raw, rule, ROUTE, f"{face}#{method}", spec, "dubbo-java")


def graphql(file: File, operation: str, name: str, role: str, line: int, raw: str, rule: str, confidence: float, source: str, request: str | None = None, response: str | None = None, operation_name: str | None = None, refs: list[str] = ()) -> dict:
    full = f"{operation.lower()}.{name}"
    spec = {"kind": "graphql-operation", "operationType": operation, "field": name, "operationName": operation_name, "fullName": full, "requestType": request, "responseType": response, "source": source}
    return fact(file, "graphql", full, role, line, raw[:160], rule, confidence, full, spec, "graphql", None, refs)


def schema(file: File, kind: str, name: str, lang: str, fields: list[dict], line: int, raw: str, rule: str, confidence: float, framework: str | None = None, bases: list[str] = ()) -> dict:
    """bases: names of schemas that this one is built on; they become references to resolve later."""
    return fact(file, kind, name, "shared", line, raw, rule, confidence, f"{kind.upper()} {name}", {"kind": "schema", "name": name, "language": lang, "fields": fields}, framework, name, [f"USES_SCHEMA:{b}" for b in bases])


def broker_of_imports(imports: list[dict]) -> str:
    for i in imports:
        for broker, needles in BROKERS:
            if any(n in i["module"].lower() for n in needles):
                return broker
    return "unknown"


def broker_of_receiver(receiver: str | None) -> str:
    r = (receiver or "").lower()
    for broker, needles in (("kafka", ("kafka",)), ("rabbitmq", ("rabbit", "amqp")), ("redis-stream", ("redis",))):
        if any(n in r for n in needles):
            return broker
    return "unknown"


def shared_kind(name: str, kind: str) -> str | None:
    if kind == "enum" or name.endswith("Enum"):
        return "enum"
    for ending, of in (("Schema", "schema"), ("Config", "config"), ("DTO", "dto"), ("Dto", "dto"), ("Payload", "dto")):
        if name.endswith(ending):
            return of
    return None


# --- packages ---------------------------------------------------------------------------------------------------------------------------------------


def package_json(file: File, found: list) -> None:
    if file.path.rsplit("/", 1)[-1] != "package.json":
        return
    try:
        manifest = json.loads(file.text)
    except ValueError:
        return
    if not isinstance(manifest, dict):
        return
    lines = file.text.split("\n")
    at = lambda *needles: next((i for i, line in enumerate(lines, 1) if all(n in line for n in needles)), 1)
    if isinstance(name := manifest.get("name"), str) and name:
        found.append(fact(file, "package", name, "owner", at('"name"', f'"{name}"'), name, "package-json-name", MANIFEST))
    for part in ("dependencies", "devDependencies", "peerDependencies"):
        of = manifest.get(part)
        for dep, version in (of if isinstance(of, dict) else {}).items():
            found.append(fact(file, "package", dep, "consumer", at(f'"{dep}"'), f'"{dep}": "{version}"', "package-json-dependency", MANIFEST))


def java_package(module: str, static: bool) -> str:
    """The package of an import: without '*', the member of a static import, and the class."""
    parts = [p for p in module.split(".") if p]
    if parts and parts[-1] == "*":
        parts.pop()
    if static and parts and module[-1] != "*":
        parts.pop()
    if parts and re.match(r"[A-Z_$]", parts[-1]):
        parts.pop()
    return ".".join(parts) or module


def import_package(file: File, found: list) -> None:
    for i in file.parsed["imports"]:
        if i["module"].startswith("."):
            continue
        static = bool(re.match(r"import\s+static\b", i["raw"]))
        key = java_package(i["module"], static) if file.language == "java" else i["module"]
        found.append(fact(file, "package", key, "consumer", i["line"], i["raw"], "import-specifier-package-owner", IMPORT))


def java_owner(file: File, found: list) -> None:
    m = re.search(r"(?:^|/)src/(?:main|test)/java/(.+)/[^/]+\.java$", file.path)
    package = file.parsed["package"] or (m and m[1].replace("/", "."))
    if package:
        line = next((i for i, x in enumerate(file.text.split("\n"), 1) if x.strip().startswith("package ")), 1)
        found.append(fact(file, "package", package, "owner", line, f"package {package}", "java-package-path", PACKAGE_PATH))


# --- JavaScript and TypeScript ----------------------------------------------------------------------------------------------------------------------

# Modules whose imports are HTTP clients, helper functions that name a method, utility types that are built on another type.
_HTTP_MODULE = re.compile(r"(?i)^(?:axios|ky|umi-request|@?/?request|.*/request|.*/http)$")
_API_CALL = re.compile(r"^api(Get|Post|Put|Patch|Delete|Request)$")


def js_http(file: File, found: list) -> None:
    s, parsed = file.source, file.parsed
    known = {"axios", "request", "http", "httpClient", "apiClient"} | {b["local"] for i in parsed["imports"] if _HTTP_MODULE.match(i["module"]) for b in i["bindings"] if b["local"]}
    names, taken = constants(s), []
    for c in s.calls:
        root = (c.receiver or "").removeprefix("this.").split(".")[0]
        verb, method, url, rule, client = c.name.lower(), None, c.args[0] if c.args else None, "http-client-api-consumer", False
        if c.receiver is None:
            shape = members(url)
            if c.name == "fetch":
                options = members(c.args[1]) if len(c.args) > 1 else {}
                method, client = (string(options.get("method")) or "GET").upper(), True
            elif m := _API_CALL.match(c.name):
                method, client = m[1].upper(), True
            elif c.name in known:
                client = True
                if "url" in shape:
                    method = (string(shape.get("method")) or "").upper() or None
            else:
                continue
            if "url" in shape:
                url, rule = shape["url"], "http-client-object-url-consumer"
        elif verb in HTTP_VERBS or verb == "request":
            client = root in known or c.receiver in known
            method = verb.upper()
            if verb == "request":
                shape = members(url)
                method = (string(shape.get("method")) or "").upper() or None
                url = shape.get("url", url) if shape else url
        else:
            continue
        taken.append((c.at, c.at + len(c.raw)))
        if url is None or not containing(parsed["symbols"], c.line):
            continue
        path = value(url, names)
        if path is None or not path.startswith("/"):
            looks = re.search(r"(?i)api|http|client|request", c.receiver or "") or re.search(r"(?i)url|uri|path", url)
            if client or (path is None and looks):
                what = "HTTP object url" if rule.endswith("object-url-consumer") else "HTTP call argument"
                found.append(audit(file, c.line, c.raw, "dynamic-unresolved", f"{what} is not a resolvable static path"))
            continue
        confidence = (CLIENT if client else PROBABLE_ROUTE) if method else UNKNOWN_METHOD
        found.append(api(file, path, "consumer", c.line, c.raw, rule, confidence, method, "js-http-client"))
    for m in re.finditer(r"""(["'`])(/api/(?:\\.|(?!\1)[^\\\n])*)\1""", s.bare):
        line = s.line(m.start())
        inside = containing(parsed["symbols"], line)
        if not inside or any(a <= m.start() < z for a, z in taken) or (m[1] == "`" and "${" in m[2]):
            continue
        serves = re.search(r"(?i)controller|route|server|api", f"{file.path} {inside['qualified_name']}")
        role, rule, confidence = ("producer", "api-path-producer", CLIENT) if serves else ("consumer", "api-path-consumer", PROBABLE_ROUTE)
        found.append(api(file, m[2], role, line, m[0], rule, confidence, framework="js-http-client"))


_PAYLOAD = re.compile(r"\bnew\s+([\w$.]+)|\bas\s+([\w$.]+)\s*$")


def js_event(file: File, found: list) -> None:
    s = file.source
    of_imports = broker_of_imports(file.parsed["imports"])
    for c in s.calls:
        if c.receiver is None or c.name not in ("publish", "emit", "send", "subscribe", "on", "consume") or not c.args:
            continue
        topic = string(c.args[0])
        broker = broker_of_receiver(c.receiver)
        broker = of_imports if broker == "unknown" else broker
        if not topic or (c.name in ("send", "on", "emit") and broker == "unknown"):
            continue
        role = "consumer" if c.name in ("subscribe", "on", "consume") else "producer"
        second = c.args[1] if len(c.args) > 1 else None
        payload = c.generics and (re.findall(r"[\w$]+", c.generics.split("<")[1]) or [None])[-1]
        if not payload and second:
            if role == "producer":
                m = _PAYLOAD.search(second)
                payload = m and (m[1] or m[2]).split(".")[-1]
            else:
                m = re.match(r"(?:async\s*)?(?:function\b[^(]*)?\(\s*[\w$]+\s*:\s*([\w$.]+)", second)
                payload = m and m[1].split(".")[-1]
        found.append(event(file, topic, role, c.line, c.raw, "event-publisher" if role == "producer" else "event-consumer", EVENT, broker, payload))
        if role == "producer" and second and not payload and second[0] not in "{[":
            found.append(audit(file, c.line, c.raw, "payload-type-unresolvable", "payload-type-unresolvable"))


# The common names of a language's types, here and below.
_TS_TYPES = {"string": "string", "number": "number", "boolean": "boolean", "Date": "date", "any": "unknown", "unknown": "unknown"}
_UTILITY = re.compile(r"^\s*(Omit|Pick|Partial|Required|Readonly|Record)\s*<\s*([\w$]+)")


def _ts_type(text: str) -> str:
    text = " ".join(text.split())
    if m := re.fullmatch(r"(?:Array|ReadonlyArray)<(.+)>|(.+)\[\]", text):
        return f"array<{_ts_type(m[1] or m[2])}>"
    return _TS_TYPES.get(text, text)


def ts_schema(file: File, found: list) -> None:
    if file.language not in ("typescript", "tsx"):
        return
    s = file.source
    for m in re.finditer(r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(interface|class|type)\s+([A-Za-z_$][\w$]*)", s.code):
        kind = shared_kind(m[2], m[1])
        if kind not in ("schema", "dto"):
            continue
        brace, stop = s.code.find("{", m.end()), s.code.find(";", m.end())
        head = s.code[m.end() : brace if brace >= 0 else len(s.code)]
        base = _UTILITY.match(head.partition("=")[2]) if m[1] == "type" else None
        fields = []
        if brace >= 0 and not (base and 0 <= stop < brace):
            end = s.shut(brace) - 1
            pieces = [p for a, z in s.split(brace + 1, end, ";") for p in _lines(s, a, z)]
            for a, z in pieces:
                f = re.match(r"\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|readonly|declare)\s+)*([A-Za-z_$][\w$]*)\s*([?!]?)\s*:\s*([^=]+)", s.code[a:z])
                if f:
                    raw = " ".join(f[3].strip().rstrip(",").split())
                    nullable = bool(re.search(r"\bnull\b", raw))
                    fields.append({"name": f[1], "type": _ts_type(re.sub(r"\s*\|\s*(?:null|undefined)\b", "", raw)), "optional": f[2] == "?" or "undefined" in raw, "nullable": nullable, "sourceLine": s.line(a + f.start(1))})
        if fields or base:
            line = s.line(m.start(1))
            found.append(schema(file, kind, m[2], "typescript", fields, line, s.text.split("\n")[line - 1].strip(), "ts-schema-fields", FIELDS, "ts-schema", [base[2]] if base else []))


def _lines(s: Source, a: int, z: int):
    """The lines of a range, lines inside brackets kept together."""
    cuts, depth = [a], 0
    for i in range(a, z):
        c = s.code[i]
        depth += (c in "([{<") - (c in ")]}") - (c == ">" and s.code[i - 1] != "=")
        if c == "\n" and depth <= 0:
            cuts.append(i + 1)
    return [(x, y) for x, y in pairwise([*cuts, z]) if s.code[x:y].strip()]


def shared_symbols(file: File, found: list) -> None:
    own = file.language in ("typescript", "tsx", "java", "python", "go")
    for x in file.parsed["symbols"]:
        kind = shared_kind(x["name"], x["kind"])
        if kind and not (own and kind in ("schema", "dto")):
            found.append(fact(file, kind, x["name"], "shared", x["start_line"], x["signature"], f"{kind}-symbol", SHARED, f"{kind.upper()} {x['name']}", symbol=x["qualified_name"]))


def js_grpc(file: File, found: list) -> None:
    s = file.source
    if not any("grpc" in i["module"] for i in file.parsed["imports"]) and not re.search(r"\bgrpc\b|GrpcClient|ServiceClient|addService", s.text):
        return
    name = lambda t: re.sub(r"(?:Client|Definition|Grpc)$", "", t) if t else None
    upper = lambda t: t[:1].upper() + t[1:]
    for c in s.calls:
        if c.name == "addService" and len(c.args) > 1:
            parts = [p for p in c.args[0].split(".") if p and p != "service"]
            service = name(re.sub(r"Service$", "Service", parts[-1])) if parts else None
            for key, body in members(c.args[1]).items():
                writes, reads = re.search(r"\.write\s*\(", body), re.search(r"""\.on\s*\(\s*['"`]data['"`]""", body)
                streaming = "bidi-stream" if writes and reads else "client-stream" if reads else "server-stream" if writes else "unary"
                if service:
                    found.append(grpc(file, "", service, upper(key), "producer", c.line, body, "js-grpc-server", ROUTE, streaming=streaming, framework="grpc-js"))
    clients = {m[1]: name(m[2].split(".")[-1]) for m in re.finditer(r"\b(?:const|let|var|this\.|private\s+|readonly\s+)\s*([\w$]+)\s*(?::[^=\n]+)?=\s*new\s+([\w$.]+?(?:Client|Service))\s*\(", s.code)}
    seen = set()
    for c in s.calls:
        service = clients.get((c.receiver or "").removeprefix("this."))
        if service and c.name not in ("close", "waitForReady", "getChannel") and (service, c.name) not in seen:
            seen.add((service, c.name))
            m = re.search(r"\bnew\s+([\w$.]+)", c.args[0]) if c.args else None
            found.append(grpc(file, "", service, upper(c.name), "consumer", c.line, c.raw, "js-grpc-client", ROUTE, m and m[1].split(".")[-1], framework="grpc-js"))


def sdk_client(file: File, found: list) -> None:
    """Generated clients: methods of a *Client or *Api class whose body names one path and verb become endpoints; calls of them are joined by resolve_sdk."""
    s = file.source
    for x in file.parsed["symbols"]:
        owner = x["qualified_name"].rpartition(".")[0]
        if x["kind"] != "method" or not re.search(r"(?:Client|Api|Sdk)$", owner):
            continue
        body = "\n".join(s.bare.split("\n")[x["start_line"] - 1 : x["end_line"]])
        path, verb = re.search(r"""["'`](/[^"'`\s]*)["'`]""", body), re.search(r"""\bmethod\s*:\s*["'`](\w+)["'`]|\.(get|post|put|patch|delete)\s*[(<]""", body)
        if path and verb:
            found.append(fact(file, "sdk", f"{owner}.{x['name']}", "mapping", x["start_line"], x["signature"], "sdk-method", 0.9, http_key(re.sub(r"\$\{(?:[\w.]*\.)?(\w+)\}", r"{\1}", path[1]), (verb[1] or verb[2]).upper()), symbol=x["qualified_name"]))
    for m in re.finditer(r"\b(?:const|let|var|private|readonly|public)\s+([\w$]+)\s*(?::\s*([\w$]+(?:Client|Api|Sdk))\b)?\s*(?:=\s*new\s+([\w$]+(?:Client|Api|Sdk))\s*\()?", s.code):
        of = m[2] or m[3]
        for c in s.calls if of else ():
            if (c.receiver or "").removeprefix("this.") == m[1]:
                found.append(fact(file, "sdk", f"{of}.{c.name}", "call", c.line, c.raw, "sdk-call", 0.9))


# --- Python -----------------------------------------------------------------------------------------------------------------------------------------

# Names that HTTP clients go by.
_PY_CLIENTS = ("requests", "httpx", "client", "session", "http_client", "api_client", "async_client")


def _text(node) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _dotted(node) -> str:
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    return node.id if isinstance(node, ast.Name) else ""


def py_http(file: File, found: list) -> None:
    p = file.parsed
    if "tree" not in p:
        return
    skip = set()
    for d in p["decorators"]:
        node = d["node"]
        skip |= {id(x) for x in ast.walk(node)}
        if not isinstance(node, ast.Call) or not node.args:
            continue
        verb, path = _dotted(node.func).split(".")[-1], _text(node.args[0])
        if verb in (*HTTP_VERBS, "route", "api_route", "websocket") and "." in _dotted(node.func) and path and path.startswith("/"):
            found.append(api(file, path, "producer", d["line"], d["raw"], "python-decorator-producer", ROUTE, verb.upper() if verb in HTTP_VERBS else None, "python"))
    for node in p["nodes"]:
        name = _dotted(node.func)
        root, _, verb = name.rpartition(".")
        owner = root.removeprefix("self.").split(".")[0]
        if id(node) in skip or verb not in (*HTTP_VERBS, "request", "urlopen") or not containing(p["symbols"], node.lineno):
            continue
        if not (owner in _PY_CLIENTS or verb == "urlopen" or re.search(r"(?i)client$|session$", root.split(".")[-1])):
            skip |= {id(x) for x in ast.walk(node)} if root else set()
            continue
        args = list(node.args)
        method = verb.upper() if verb in HTTP_VERBS else None
        if verb == "request" and args:
            method = (_text(args.pop(0)) or "").upper() or None
        url = args[0] if args else next((k.value for k in node.keywords if k.arg == "url"), None)
        skip |= {id(x) for x in ast.walk(node)}
        raw = ast.get_source_segment(file.text, node) or ""
        path = _text(url)
        if path is None or not path.startswith("/"):
            found.append(audit(file, node.lineno, raw, "dynamic-unresolved", "HTTP call argument is not a resolvable static path"))
        else:
            found.append(api(file, path, "consumer", node.lineno, raw, "python-http-client-consumer", CLIENT if method else UNKNOWN_METHOD, method, "python"))
    for node in ast.walk(p["tree"]):
        path = _text(node)
        if path and path.startswith("/api/") and id(node) not in skip and containing(p["symbols"], node.lineno):
            found.append(api(file, path, "consumer", node.lineno, repr(path), "python-api-path-consumer", PROBABLE_ROUTE, framework="python"))


def py_event(file: File, found: list) -> None:
    p = file.parsed
    if "tree" not in p:
        return
    if any("celery" in i["module"].lower() for i in p["imports"]):
        for d in p["decorators"]:
            node = d["node"].func if isinstance(d["node"], ast.Call) else d["node"]
            if _dotted(node).split(".")[-1] in ("task", "shared_task"):
                found.append(event(file, d["owner"], "consumer", d["line"], d["raw"], "python-celery-task", ANNOTATION, "unknown", framework="celery"))
    of_imports = broker_of_imports(p["imports"])
    if of_imports == "unknown":
        return
    # Calls, their role, the broker they imply, and the keyword that holds the topic (None: the first argument).
    calls = {"send": ("producer", None, None), "produce": ("producer", "kafka", None), "basic_publish": ("producer", "rabbitmq", "routing_key"), "publish": ("producer", "redis-stream", None), "xadd": ("producer", "redis-stream", None), "subscribe": ("consumer", None, None), "basic_consume": ("consumer", "rabbitmq", "queue")}
    for node in p["nodes"]:
        if not isinstance(node.func, ast.Attribute) or node.func.attr not in calls:
            continue
        role, broker, keyword = calls[node.func.attr]
        arg = next((k.value for k in node.keywords if k.arg == keyword), None) if keyword else (node.args[0] if node.args else None)
        if isinstance(arg, ast.List | ast.Tuple):
            arg = arg.elts[0] if arg.elts else None
        if topic := _text(arg):
            found.append(event(file, topic, role, node.lineno, ast.get_source_segment(file.text, node) or "", f"python-event-{role}", EVENT, broker or of_imports))


_PY_TYPES = {"str": "string", "int": "number", "float": "number", "bool": "boolean", "Decimal": "number", "datetime": "date", "date": "date", "Any": "unknown"}


def _py_type(text: str) -> tuple[str, bool]:
    """A type's common name, and whether it may be None."""
    text = text.strip().strip("\"'")
    optional = False
    if m := re.fullmatch(r"(?:typing\.)?Optional\[(.+)\]", text):
        text, optional = m[1], True
    parts = [x.strip() for x in text.split("|")]
    if len(parts) > 1 and "None" in parts:
        text, optional = " | ".join(x for x in parts if x != "None"), True
    if m := re.fullmatch(r"(?:typing\.)?(?:List|list|Sequence|Set|set)\[(.+)\]", text):
        return f"array<{_py_type(m[1])[0]}>", optional
    return _PY_TYPES.get(text.split(".")[-1], text), optional


def py_schema(file: File, found: list) -> None:
    tree = file.parsed.get("tree")
    for node in ast.walk(tree) if tree else ():
        if not isinstance(node, ast.ClassDef) or (kind := shared_kind(node.name, "class")) not in ("schema", "dto"):
            continue
        marks = {_dotted(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list}
        bases = [_dotted(b).split(".")[-1] for b in node.bases]
        base = next((b for b in bases if b in ("BaseModel", "TypedDict", "NamedTuple")), None)
        inherits = [b for b in bases if b not in ("BaseModel", "TypedDict", "NamedTuple", "object", "ABC", "Generic", "Enum", "Protocol") and b]
        if not base and not marks & {"dataclass", "dataclasses.dataclass"}:
            if not any(shared_kind(b, "class") for b in inherits):
                continue
        fields = []
        for x in node.body:
            if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
                of, none = _py_type(ast.unparse(x.annotation))
                fields.append({"name": x.target.id, "type": of, "optional": none or x.value is not None, "nullable": none, "sourceLine": x.lineno})
        if fields:
            framework = {"BaseModel": "python-pydantic"}.get(base) or (f"python-{base.lower()}" if base else "python-dataclass")
            found.append(schema(file, kind, node.name, "python", fields, node.lineno, file.text.split("\n")[node.lineno - 1].strip(), "python-schema-fields", FIELDS, framework, inherits))


def py_grpc(file: File, found: list) -> None:
    tree = file.parsed.get("tree")
    if not tree:
        return
    raw = lambda node: ast.get_source_segment(file.text, node) or ""
    for node in ast.walk(tree):
        of = next((m[1] for b in getattr(node, "bases", ()) if (m := re.fullmatch(r"(\w+)Servicer", _dotted(b).split(".")[-1]))), None) if isinstance(node, ast.ClassDef) else None
        for f in node.body if of else ():
            if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef) and not f.name.startswith("_") and len(f.args.args) >= 3:
                streams = any(isinstance(x, ast.Yield | ast.YieldFrom) for x in ast.walk(f))
                reads = "iterator" in f.args.args[1].arg
                found.append(grpc(file, "", of, f.name, "producer", f.lineno, raw(f), "python-grpc-server", ROUTE, streaming="bidi-stream" if streams and reads else "server-stream" if streams else "client-stream" if reads else "unary", framework="grpc-python"))
    stubs = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and (m := re.fullmatch(r"(\w+)Stub", _dotted(node.value.func).split(".")[-1])):
            stubs |= {_dotted(t): m[1] for t in node.targets}
    seen = set()
    for node in file.parsed["nodes"]:
        root, _, name = _dotted(node.func).rpartition(".")
        if (of := stubs.get(root)) and (of, name) not in seen:
            seen.add((of, name))
            request = _dotted(node.args[0].func).split(".")[-1] if node.args and isinstance(node.args[0], ast.Call) else None
            found.append(grpc(file, "", of, name, "consumer", node.lineno, raw(node), "python-grpc-client", ROUTE, request, framework="grpc-python"))


# --- Java -------------------------------------------------------------------------------------------------------------------------------------------

# Annotations that map a method to a verb.
_MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "PatchMapping": "PATCH", "DeleteMapping": "DELETE", "RequestMapping": None}


def _strings(arg: str | None, names: dict[str, str]) -> list[str]:
    """The string values of an annotation's argument, which may be an array."""
    arg = (arg or "").strip()
    parts = [arg]
    if arg.startswith("{"):
        s = Source(arg)
        parts = [s.bare[a:z].strip() for a, z in s.split(1, s.shut(0) - 1)]
    return [v for v in (value(x, names) for x in parts) if v is not None]


def _classes(s: Source) -> list[tuple[str, int, int, int]]:
    """Name, head's start, body's start and end of each class or interface."""
    return [(m[2], m.start(), a, z) for m, a, z in s.blocks(r"\b(class|interface|record)\s+([A-Za-z_$][\w$]*)[^;{]*(?=\{)")]


def spring(file: File, found: list) -> None:
    s, names = file.source, constants(file.source)
    marks = file.parsed["annotations"]
    classes = _classes(s)
    for name, head, a, z in classes:
        before = max([y for _, _, _, y in classes if y < head], default=0)
        own = [m for m in marks if before <= m["at"] < head and not any(x < m["at"] < y for n, _, x, y in classes if n != name and x > a)]
        if not any(m["name"] in ("RestController", "Controller", "FeignClient") for m in own):
            continue
        client = any(m["name"] == "FeignClient" for m in own)
        path_of = lambda m: (_strings(m["args"].get("value") or m["args"].get("path") or m["args"].get(""), names) or [""])
        base = next((path_of(m)[0] for m in own if m["name"] == "RequestMapping"), "")
        for m in marks:
            if m["name"] not in _MAPPINGS or not a < m["at"] < z or any(x < m["at"] < y for n, _, x, y in classes if x > a and y <= z and n != name):
                continue
            verb = _MAPPINGS[m["name"]]
            if verb is None and (given := re.findall(r"\b(?:RequestMethod\.)?(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\b", m["args"].get("method", ""))):
                verb = given[0]
            head_text = s.bare[m["end"] : m["end"] + 600].split("{")[0]
            body = re.search(r"@RequestBody\s+(?:@\w+\s+|final\s+)*([\w.]+)", head_text)
            result = re.search(r"\b(?:public|protected|private)?\s*([\w.<>\[\], ]+?)\s+\w+\s*\(", re.sub(r"@\w+(?:\([^)]*\))?", "", head_text))
            inner = re.search(r"(\w+)>*$", result[1].strip()) if result else None
            response = inner[1] if inner and inner[1] not in ("void", "Void", "Object", "String") else None
            for path in path_of(m):
                found.append(api(file, f"{base}/{path}" if base and path else base or path or "/", "consumer" if client else "producer", m["line"], m["raw"], "spring-mvc-mapping", ROUTE, verb, "spring-mvc", body and body[1].split(".")[-1], response))


def java_event(file: File, found: list) -> None:
    s, names = file.source, constants(file.source)
    concrete = lambda t: t and "${" not in t and "#{" not in t
    for m in file.parsed["annotations"]:
        broker, arg = {"KafkaListener": ("kafka", "topics"), "RabbitListener": ("rabbitmq", "queues")}.get(m["name"], (None, None))
        for topic in _strings(m["args"].get(arg) or m["args"].get(""), names) if broker else ():
            if concrete(topic):
                found.append(event(file, topic, "consumer", m["line"], m["raw"], "java-event-listener", ANNOTATION, broker))
    of_imports = broker_of_imports(file.parsed["imports"])
    for c in s.calls if of_imports != "unknown" else ():
        if c.name not in ("send", "convertAndSend"):
            continue
        topic = next((t for t in map(string, c.args) if t is not None), None)
        if concrete(topic):
            broker = "kafka" if "kafka" in (c.receiver or "").lower() else "rabbitmq" if c.name == "convertAndSend" else of_imports
            found.append(event(file, topic, "producer", c.line, c.raw, "java-event-producer", EVENT, broker))


_JAVA_TYPES = {"String": "string", "int": "number", "Integer": "number", "long": "number", "Long": "number", "double": "number", "Double": "number", "float": "number", "Float": "number", "short": "number", "BigDecimal": "number", "BigInteger": "number", "boolean": "boolean", "Boolean": "boolean", "LocalDate": "date", "LocalDateTime": "date", "Date": "date", "Instant": "date", "Object": "unknown"}


def _java_type(text: str) -> str:
    text = text.strip()
    if m := re.fullmatch(r"(?:List|Set|Collection)<(.+)>|(.+)\[\]", text):
        return f"array<{_java_type(m[1] or m[2])}>"
    return _JAVA_TYPES.get(text, text)


def java_schema(file: File, found: list) -> None:
    s = file.source
    for name, head, a, z in _classes(s):
        kind = shared_kind(name, "class")
        if kind not in ("schema", "dto"):
            continue
        parent = re.search(r"\bextends\s+([\w.]+)", s.code[head:a])
        fields = []
        for x, y in s.split(a, z, ";"):
            text = re.sub(r"@\w+(?:\([^)]*\))?", "", s.code[x:y])
            m = re.fullmatch(r"\s*(?:(?:private|protected|public|final|transient|volatile)\s+)*([\w.<>\[\], ?]+?)\s+([a-z_]\w*)\s*(?:=.*)?", text.rsplit("}", 1)[-1], re.S)
            if m and not re.search(r"\b(?:static|return|class|import|throw|new)\b", text.rsplit("}", 1)[-1]):
                needed = re.search(r"@(?:NotNull|NotBlank|NotEmpty|NonNull)\b", s.code[x:y])
                fields.append({"name": m[2], "type": _java_type(m[1]), "optional": not needed and "Optional<" in m[1], "sourceLine": s.line(x + s.code[x:y].rfind(m[2]))})
        if fields or parent:
            before = s.code[max(0, head - 200) : head]
            found.append(schema(file, kind, name, "java", fields, s.line(head), s.text.split("\n")[s.line(head) - 1].strip(), "java-schema-fields", FIELDS, "lombok" if re.search(r"@Data\b", before) else "java-pojo", [parent[1].split(".")[-1]] if parent else []))


def _java_names(file: File) -> tuple[dict[str, str], str | None]:
    return {i["module"].split(".")[-1]: i["module"] for i in file.parsed["imports"]}, file.parsed["package"]


def java_dubbo(file: File, found: list) -> None:
    s, marks = file.source, file.parsed["annotations"]
    names, package = _java_names(file)
    ours = lambda m, short: m["name"] == f"Dubbo{short}" or (m["name"] == short and "dubbo" in names.get(short, ""))
    full = lambda t: t if "." in t else names.get(t) or (f"{package}.{t}" if package else t)
    attr = lambda m, k: string(m["args"].get(k))
    fields = {}
    for m in marks:
        if ours(m, "Reference"):
            f = re.match(r"\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:private|protected|public|final)\s+)*([\w.]+)(?:<[^>]*>)?\s+(\w+)\s*[;=]", s.code[m["end"] :])
            if f:
                fields[f[2]] = (full(f[1]), attr(m, "group"), attr(m, "version"))
    for name, head, a, z in _classes(s):
        mark = next((m for m in marks if ours(m, "Service") and m["end"] <= head and not re.search(r"[{};]", s.code[m["end"] : head])), None)
        faces = [re.sub(r"<.*>", "", f).strip() for f in re.sub(r"<[^<>]*>", "", (re.search(r"\bimplements\s+([^{]+)", s.code[head:a]) or ["", ""])[1]).split(",") if f.strip()]
        if not mark or not faces:
            continue
        face = full(next((f for f in faces if f.endswith("Service")), faces[0]))
        for k, b, _ in methods(s, a, z):
            shut = s.shut(k.end() - 1)
            types = [" ".join(re.sub(r"@\w+(?:\([^)]*\))?|\bfinal\b", "", s.code[x:y]).split()).rpartition(" ")[0] for x, y in s.split(k.end(), shut - 1)]
            before = re.search(r"([\w.<>\[\]]+)\s+$", s.code[: k.start()])
            if k[1] != name:
                found.append(dubbo(file, face, k[1], "producer", s.line(k.start()), s.bare[k.start() : b].strip(" {"), "java-dubbo-service", attr(mark, "group"), attr(mark, "version"), "annotation", [t for t in types if t], before and before[1]))
    seen = set()
    for c in s.calls:
        got = fields.get((c.receiver or "").removeprefix("this."))
        if got and (got[0], c.name) not in seen:
            seen.add((got[0], c.name))
            types = [m[1] or m[2] for x in c.args if (m := re.search(r"\b(\w+)\.newBuilder\s*\(|\bnew\s+(\w+)\s*\(", x))]
            found.append(dubbo(file, got[0], c.name, "consumer", c.line, c.raw, "java-dubbo-reference", got[1], got[2], "annotation", types))


def java_grpc(file: File, found: list) -> None:
    s = file.source
    upper = lambda t: t[:1].upper() + t[1:]
    for name, head, a, z in _classes(s):
        m = re.search(r"\bextends\s+(?:[\w.]+\.)?(\w+)ImplBase\b", s.code[head:a])
        for k, _, y in methods(s, a, z) if m else ():
            if re.search(r"@Override\s+(?:public\s+)?[\w<>.]+\s+$", s.code[: k.start()]) and k[1] != name:
                request = re.match(r"\s*(?:final\s+)?([\w.]+)", s.code[k.end() :])
                response = re.search(r"StreamObserver<\s*([\w.]+)", s.code[k.end() : s.shut(k.end() - 1)])
                found.append(grpc(file, "", m[1], upper(k[1]), "producer", s.line(k.start()), s.bare[k.start() : y], "java-grpc-server", ROUTE, request and request[1].split(".")[-1], response and response[1].split(".")[-1], framework="grpc-java"))
    stubs = {m[2]: m[1] for m in re.finditer(r"\b(?:[\w.]+\.)?(\w+?)(?:Blocking|Future|Async)?Stub\s+(\w+)\s*[;=]", s.code)}
    seen = set()
    for c in s.calls:
        of = stubs.get((c.receiver or "").removeprefix("this."))
        if of and not c.name.startswith("with") and (of, c.name) not in seen:
            seen.add((of, c.name))
            found.append(grpc(file, "", of, upper(c.name), "consumer", c.line, c.raw, "java-grpc-client", ROUTE, framework="grpc-java"))


# --- Go ---------------------------------------------------------------------------------------------------------------------------------------------

_GO_TYPES = {"string": "string", "bool": "boolean", "byte": "number", "rune": "number", "float32": "number", "float64": "number", "time.Time": "date", "any": "unknown", "interface{}": "unknown", "error": "string"}


def _go_type(text: str) -> str:
    text = text.strip()
    if text.startswith("*"):
        return f"{_go_type(text[1:])}?"
    if text.startswith("[]"):
        return f"array<{_go_type(text[2:])}>"
    if m := re.fullmatch(r"map\[(\w+)\](.+)", text):
        return f"map<{_go_type(m[1])}, {_go_type(m[2])}>"
    return "number" if re.fullmatch(r"u?int\d*", text) else _GO_TYPES.get(text, text.split(".")[-1])


def go_http(file: File, found: list) -> None:
    s, names = file.source, constants(file.source)
    for c in s.calls:
        path = value(c.args[0], names) if c.args else None
        if c.receiver and c.name in ("HandleFunc", "Handle") and path and path.startswith("/") and len(c.args) > 1:
            found.append(api(file, path, "producer", c.line, c.raw, "go-route-producer", ROUTE, None, "go"))
        elif c.receiver and c.name in ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS") and path and path.startswith("/") and len(c.args) > 1:
            found.append(api(file, path, "producer", c.line, c.raw, "go-route-producer", ROUTE, c.name, "go"))
        elif c.receiver == "http" and c.name in ("Get", "Post", "Head", "PostForm", "NewRequest", "NewRequestWithContext"):
            args, method = list(c.args), {"Get": "GET", "Post": "POST", "PostForm": "POST", "Head": "HEAD"}.get(c.name)
            if c.name.startswith("NewRequest"):
                args = args[1:] if c.name.endswith("Context") else args
                given = args[0] if args else ""
                method = string(given) or (given[len("http.Method") :].upper() if given.startswith("http.Method") else None)
                args = args[1:]
            path = value(args[0], names) if args else None
            bare = re.sub(r"^https?://[^/]+", "", path) if path else None
            if bare and bare.startswith("/"):
                found.append(api(file, bare, "consumer", c.line, c.raw, "go-http-client-consumer", CLIENT if method else UNKNOWN_METHOD, method, "go"))
            else:
                found.append(audit(file, c.line, c.raw, "dynamic-unresolved", "HTTP call argument is not a resolvable static path"))


def go_event(file: File, found: list) -> None:
    s = file.source
    modules = " ".join(i["module"].lower() for i in file.parsed["imports"])
    if "nats" in modules:
        for c in s.calls:
            if c.receiver and c.name in ("Publish", "Subscribe", "QueueSubscribe", "PublishMsg", "ChanSubscribe") and c.args and (topic := string(c.args[0])):
                role = "producer" if c.name.startswith("Publish") else "consumer"
                found.append(event(file, topic, role, c.line, c.raw, f"go-event-{role}", EVENT, "nats"))
    if any(n in modules for n in ("kafka", "sarama")):
        for m in re.finditer(r"\b[\w.]*?(ProducerMessage|Message|ReaderConfig|WriterConfig|Writer)\s*\{", s.code):
            end = s.shut(m.end() - 1)
            topic = next(((k, s.bare[a:z]) for a, z in s.split(m.end(), end - 1) if (k := re.match(r"\s*Topic\s*:\s*", s.bare[a:z]))), None)
            if not topic:
                continue
            literal, line = string(topic[1][topic[0].end() :]), s.line(m.start())
            role = "consumer" if m[1] == "ReaderConfig" else "producer"
            if literal:
                found.append(event(file, literal, role, line, s.bare[m.start() : end], f"go-event-{role}", EVENT, "kafka"))
            else:
                found.append(audit(file, line, s.bare[m.start() : end], "event-topic-unresolvable", "event-topic-unresolvable"))


def go_schema(file: File, found: list) -> None:
    s = file.source
    for m, a, z in s.blocks(r"(?m)^\s*(?:type\s+)?(\w+)\s+struct\s*(?=\{)"):
        kind = shared_kind(m[1], "struct")
        if kind not in ("schema", "dto"):
            continue
        fields, bases = [], []
        for x, y in _lines(s, a, z):
            text, tag = s.code[x:y].split("`")[0].strip(), re.search(r'`[^`]*json:"([^",]*)(,[^"]*)?"', s.bare[x:y])
            if f := re.fullmatch(r"(\w+(?:\s*,\s*\w+)*)\s+([\w.*\[\]{}]+)", text):
                for name in re.split(r"\s*,\s*", f[1]):
                    of = _go_type(f[2])
                    fields.append({"name": (tag and tag[1] not in ("", "-") and tag[1]) or name, "type": of, "optional": of.endswith("?") or bool(tag and "omitempty" in (tag[2] or "")), "nullable": of.endswith("?"), "sourceLine": s.line(x + len(s.code[x:y]) - len(s.code[x:y].lstrip()))})
            elif f := re.fullmatch(r"\*?([\w.]+)", text):
                bases.append(f[1].split(".")[-1])
        if fields or bases:
            line = s.line(m.start(1))
            found.append(schema(file, kind, m[1], "go", fields, line, s.text.split("\n")[line - 1].strip(), "go-schema-fields", FIELDS, "go-struct", bases))


def go_grpc(file: File, found: list) -> None:
    s = file.source
    of = {}
    for m, a, z in s.blocks(r"(?m)^\s*(?:type\s+)?(\w+)\s+struct\s*(?=\{)"):
        if k := re.search(r"(?m)^\s*\*?(?:\w+\.)?Unimplemented(\w+)Server\s*$", s.code[a:z]):
            of[m[1]] = k[1]
    for m, _, z in s.blocks(r"(?m)^func\s+\(\s*\w*\s*\*?\s*(\w+)\s*\)\s*([A-Z]\w*)\s*\([^{]*(?=\{)"):
        if service := of.get(m[1]):
            args = s.code[s.code.find("(", m.end(2)) : s.shut(s.code.find("(", m.end(2)))]
            types = re.findall(r"\*(?:\w+\.)?(\w+)", args)
            stream = re.search(r"(?:\w+\.)?\w+_\w+Server\b", args)
            answer = re.search(r"\)\s*\(\s*\*(?:\w+\.)?(\w+)\s*,", s.code[m.start() : m.end() + 1])
            found.append(grpc(file, "", service, m[2], "producer", s.line(m.start()), s.bare[m.start() : z + 1], "go-grpc-server", ROUTE, types[0] if types else None, answer and answer[1], "server-stream" if stream and types else "bidi-stream" if stream else "unary", "grpc-go"))
    clients = {m[1]: m[2] for m in re.finditer(r"(\w+)\s*(?::=|=)\s*(?:\w+\.)?New(\w+)Client\s*\(", s.code)}
    seen = set()
    for c in s.calls:
        service = clients.get(c.receiver or "")
        if service and (service, c.name) not in seen:
            seen.add((service, c.name))
            m = re.search(r"&(?:\w+\.)?(\w+)\s*\{", " ".join(c.args))
            found.append(grpc(file, "", service, c.name, "consumer", c.line, c.raw, "go-grpc-client", ROUTE, m and m[1], framework="grpc-go"))


# --- definitions and configuration ------------------------------------------------------------------------------------------------------------------

_PROTO_TYPES = {"string": "string", "bool": "boolean", "bytes": "string", "double": "number", "float": "number"}


def _proto_type(text: str) -> str:
    return "number" if re.fullmatch(r"s?[u]?(?:int|fixed)\d+|s(?:int|fixed)\d+", text) else _PROTO_TYPES.get(text, text)


def proto(file: File, found: list) -> None:
    s = file.source
    package = (re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", s.code) or ["", ""])[1]
    for m, a, z in s.blocks(r"\bservice\s+(\w+)\s*(?=\{)"):
        for k in re.finditer(r"\brpc\s+(\w+)\s*\(\s*(stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(stream\s+)?([\w.]+)\s*\)", s.code[a:z]):
            streaming = "bidi-stream" if k[2] and k[4] else "client-stream" if k[2] else "server-stream" if k[4] else "unary"
            found.append(grpc(file, package, m[1], k[1], "shared", s.line(a + k.start()), k[0], "proto-rpc", 1.0, k[3], k[5], streaming, "proto"))

    def message(a: int, z: int, owner: str) -> None:
        at = a
        while m := re.compile(r"\bmessage\s+(\w+)\s*\{").search(s.code, at, z):
            end = s.shut(m.end() - 1)
            name, body, inner = f"{owner}.{m[1]}" if owner else m[1], s.code[m.end() : end - 1], []
            own = re.sub(r"\b(?:message|enum)\s+\w+\s*\{(?:[^{}]|\{[^{}]*\})*\}", lambda x: re.sub(r"[^\n]", " ", x[0]), body)
            for f in re.finditer(r"(?:\b(repeated|optional|required)\s+)?(map\s*<\s*\w+\s*,\s*[\w.]+\s*>|[\w.]+)\s+(\w+)\s*=\s*\d+", own):
                kind = re.sub(r"\s+", "", f[2]).replace(",", ", ") if f[2].startswith("map") else _proto_type(f[2])
                inner.append({"name": f[3], "type": f"array<{kind}>" if f[1] == "repeated" else kind, "optional": f[1] == "optional", "sourceLine": s.line(m.end() + f.start(3))})
            key = f"{package}.{name}" if package else name
            found.append(schema(file, "schema", key, "proto", inner, s.line(m.start()), s.bare[m.start() : end], "proto-schema", 1.0))
            message(m.end(), end - 1, name)
            at = end

    message(0, len(s.code), "")


def dubbo_xml(file: File, found: list) -> None:
    for m in re.finditer(r"(?i)<dubbo:(service|reference)\b([^>]*?)/?>", file.text):
        attrs = {k: a or b for k, a, b in re.findall(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""", m[2])}
        if attrs.get("interface"):
            role = "producer" if m[1].lower() == "service" else "consumer"
            found.append(dubbo(file, attrs["interface"], "*", role, file.text.count("\n", 0, m.start()) + 1, m[0], f"dubbo-xml-{m[1].lower()}", attrs.get("group"), attrs.get("version"), "xml"))


_GQL_NOISE = re.compile(r'"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"|#[^\n]*')


def _gql(text: str) -> Source:
    return Source(_GQL_NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text))


def graphql_sdl(file: File, found: list) -> None:
    s = _gql(file.text)
    base = lambda t: re.sub(r"[\[\]!\s]", "", t)
    roots = {"Query": "query", "Mutation": "mutation", "Subscription": "subscription"}
    for m, a, z in s.blocks(r"(?m)^\s*schema\b[^{]*(?=\{)"):
        roots = {k[2]: k[1] for k in re.finditer(r"\b(query|mutation|subscription)\s*:\s*(\w+)", s.code[a:z])}
    for m, a, z in s.blocks(r"(?m)^\s*(?:extend\s+)?(type|input)\s+(\w+)[^{]*(?=\{)"):
        fields = []
        for f in re.finditer(r"(\w+)\s*(\([^)]*\))?\s*:\s*([\[\]\w!]+)", re.sub(r"@\w+(?:\([^)]*\))?", lambda x: " " * len(x[0]), s.code[a:z])):
            line = s.line(a + f.start())
            fields.append({"name": f[1], "type": f[3], "optional": not f[3].endswith("!"), "nullable": not f[3].endswith("!"), "sourceLine": line})
            if m[2] in roots and m[1] == "type":
                args = [base(t) for t in re.findall(r":\s*([\[\]\w!]+)", f[2] or "")]
                found.append(graphql(file, roots[m[2]], f[1], "shared", line, f[0], "graphql-sdl-operation", 1.0, "sdl", args[0] if args else None, base(f[3]), refs=[f"RESPONSE_SCHEMA:{base(f[3])}", *(f"REQUEST_SCHEMA:{t}" for t in args)]))
        found.append(schema(file, "schema", m[2], "graphql", fields, s.line(m.start(1)), file.text[m.start(1) : z + 1][:160], "graphql-schema-type", 1.0))


def _operations(text: str) -> list[tuple[str, str, str | None, int, str]]:
    """Operation, root field, name, line and text of a client document."""
    s, out = _gql(text), []
    at = 0
    while m := re.compile(r"\b(query|mutation|subscription)\b\s*(\w+)?\s*(?:\([^{]*\))?\s*(?:@\w+(?:\([^)]*\))?\s*)*\{").search(s.code, at):
        end = s.shut(m.end() - 1)
        depth, i = 0, m.end()
        while i < end - 1:
            c = s.code[i]
            if c in "{(":
                i = s.shut(i)
                continue
            f = re.compile(r"(?:\w+\s*:\s*)?([A-Za-z_]\w*)").match(s.code, i)
            if f and s.code[i - 1] not in ".@$" and depth == 0:
                out.append((m[1], f[1], m[2], s.line(i), text[m.start() : end]))
                i = f.end()
                continue
            i += 1
        at = end
    return out


def graphql_client(file: File, found: list) -> None:
    if file.language == "graphql":
        for kind, name, of, line, raw in _operations(file.text):
            found.append(graphql(file, kind, name, "consumer", line, raw, "graphql-client-file", ROUTE, "client-document", operation_name=of))
        return
    for m in re.finditer(r"(?:\b(?:gql|graphql)\s*|/\*\s*GraphQL\s*\*/\s*)\(?\s*`([^`]*)`", file.text):
        line = file.text.count("\n", 0, m.start(1)) + 1
        for kind, name, of, at, raw in _operations(m[1]):
            found.append(graphql(file, kind, name, "consumer", line + at - 1, raw, "graphql-client-template", REGEX_ROUTE, "client-document", operation_name=of))


# Fixed value: what a configuration key looks like.
_CONFIG_KEY = re.compile(r"^(?:[A-Z][A-Z0-9_]{2,}|[a-z][A-Za-z0-9_.-]+\.[A-Za-z0-9_.-]+)$")


def _flat(node, prefix: str = "") -> list[str]:
    if not isinstance(node, dict):
        return [prefix] if prefix else []
    out = []
    for k, v in node.items():
        name = f"{prefix}.{k}" if prefix else str(k)
        out += _flat(v, name) if isinstance(v, dict) and v else [name]
    return out


def config_keys(lang: str, text: str) -> list[tuple[str, int, str]]:
    """Flattened keys of a configuration file with their lines; a file that can't be read has none."""
    lines = text.split("\n")
    if lang == "yaml":
        try:
            import yaml

            keys = [k for doc in yaml.safe_load_all(text) for k in _flat(doc)]
        except Exception:  # noqa: BLE001  any broken file
            return []
        at = lambda leaf: next((i for i, x in enumerate(lines, 1) if re.match(rf"\s*{re.escape(leaf)}\s*[:=]", x)), 0)
        return [(k, max(1, n := at(k.split(".")[-1])), lines[n - 1].strip() if n else k) for k in keys]
    out, section = [], ""
    for n, line in enumerate(lines, 1):
        t = line.strip()
        if not t or t.startswith("#") or (lang == "properties" and t.startswith("!")):
            continue
        if lang == "toml":
            if m := re.fullmatch(r"\[([^\]]+)\]", t):
                section = m[1].strip()
            elif m := re.match(r"([A-Za-z0-9_.-]+)\s*=", t):
                out.append((f"{section}.{m[1]}" if section else m[1], n, t))
        elif m := re.match(r"([^:=\s][^:=]*?)\s*[:=]", t):
            out.append((m[1].strip(), n, t))
    return out


def env_config(file: File, found: list) -> None:
    if file.language in ("yaml", "toml", "properties"):
        for key, line, raw in config_keys(file.language, file.text):
            found.append(fact(file, "config", key, "shared", line, raw, "config-file-key", CONFIG_FILE))
        return
    s = file.source
    for m in re.finditer(r"""\bprocess\.env(?:\.([A-Za-z_$][\w$]*)|\[\s*(["'`])([^"'`]+)\2\s*\])|\bconfig\.get\s*(?:<[^>]*>)?\(\s*(["'`])([^"'`$]+)\4""", s.bare):
        key = m[1] or m[3] or m[5]
        if _CONFIG_KEY.match(key) and s.code[m.start()] == s.bare[m.start()]:
            found.append(fact(file, "config", key, "shared", s.line(m.start()), m[0] + (")" if m[5] else ""), "config-key-reference", CONFIG_REF))


# --- C# ---------------------------------------------------------------------------------------------------------------------------------------------


def csharp(file: File, found: list) -> None:
    """Controllers, minimal APIs, HttpClient calls, records and classes with a shared name, Kafka and RabbitMQ calls; package references of projects."""
    if file.path.endswith(".csproj"):
        for m in re.finditer(r"""<PackageReference\s+[^>]*Include\s*=\s*"([^"]+)\"""", file.text):
            found.append(fact(file, "package", m[1], "consumer", file.text.count("\n", 0, m.start()) + 1, m[0], "csproj-package-reference", MANIFEST))
        return
    s = Source(file.text)
    for m, a, z in s.blocks(r"\bclass\s+(\w+)[^;{]*(?=\{)"):
        head = s.bare[max(0, m.start() - 400) : m.start()].rsplit("}", 1)[-1]
        route = re.findall(r'\[Route\(\s*"([^"]*)"', head)
        base = route[-1].replace("[controller]", re.sub(r"Controller$", "", m[1]).lower()) if route else ""
        for k in re.finditer(r'\[Http(Get|Post|Put|Patch|Delete)(?:\(\s*"([^"]*)"[^)]*\))?\s*\]', s.bare[a:z]) if m[1].endswith("Controller") else ():
            path = "/".join(x for x in (base.strip("/"), (k[2] or "").strip("/")) if x)
            found.append(api(file, "/" + re.sub(r"\{(\w+)[^}]*\}", r"{\1}", path), "producer", s.line(a + k.start()), k[0], "csharp-controller-route", ROUTE, k[1].upper(), "aspnet"))
        kind = shared_kind(m[1], "class")
        fields = [{"name": f[2], "type": f[1].rstrip("?"), "optional": f[1].endswith("?"), "sourceLine": s.line(a + f.start(2))} for f in re.finditer(r"\bpublic\s+(?:required\s+)?([\w<>\[\]?.]+)\s+(\w+)\s*\{\s*get", s.code[a:z])] if kind in ("schema", "dto") else []
        if fields:
            found.append(schema(file, kind, m[1], "csharp", fields, s.line(m.start()), m[0].strip(), "csharp-schema-fields", FIELDS, "csharp-class"))
    for c in s.calls:
        if m := re.fullmatch(r"Map(Get|Post|Put|Patch|Delete)", c.name):
            if c.args and (path := string(c.args[0])):
                found.append(api(file, path, "producer", c.line, c.raw, "csharp-minimal-api", ROUTE, m[1].upper(), "aspnet"))
        elif m := re.fullmatch(r"(Get|Post|Put|Patch|Delete)(?:Async|FromJsonAsync|AsJsonAsync|StringAsync)", c.name):
            path = string(c.args[0].lstrip("$")) if c.args else None
            if path and path.startswith("/"):
                found.append(api(file, path, "consumer", c.line, c.raw, "csharp-http-client", CLIENT, m[1].upper(), "httpclient"))
        elif c.name in ("ProduceAsync", "BasicPublish", "BasicPublishAsync", "Subscribe", "BasicConsume", "BasicConsumeAsync"):
            topic = next((t for t in map(string, c.args) if t), None)
            broker = "rabbitmq" if c.name.startswith("Basic") else "kafka"
            role = "producer" if c.name.removesuffix("Async") in ("Produce", "BasicPublish") else "consumer"
            if topic:
                found.append(event(file, topic, role, c.line, c.raw, f"csharp-event-{role}", EVENT, broker))


# Readers of each language, in the order in which their facts count: the last of equal ones stays.
READERS = {
    **{x: (js_http, sdk_client, js_event, ts_schema, shared_symbols, js_grpc, env_config, graphql_client, import_package) for x in SCRIPT},
    "python": (py_http, py_event, py_schema, py_grpc, shared_symbols, import_package),
    "java": (spring, java_event, java_schema, java_dubbo, java_grpc, shared_symbols, java_owner, import_package),
    "go": (go_http, go_event, go_schema, go_grpc, shared_symbols, import_package),
    "proto": (proto,), "graphql": (graphql_sdl, graphql_client), "xml": (dubbo_xml, csharp), "json": (package_json,), "csharp": (csharp,),
    "yaml": (env_config,), "toml": (env_config,), "properties": (env_config,),
}


def facts_of(file: File, only: set[str] | None = None) -> list[dict]:
    """All facts of a file; only: names of the readers that may run."""
    found: list[dict] = []
    for reader in READERS.get(file.language, ()):
        if only is None or reader.__name__ in only:
            reader(file, found)
    return found
