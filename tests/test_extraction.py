"""Readers of source files, on small sources of our own."""

import json

import pytest

from specgraph.extraction import contracts as C
from specgraph.extraction.parse import language, parse, vue_script
from specgraph.extraction.source import Source, members, value


def facts(path, text, *rules):
    got = C.facts_of(C.File("repo:r", f"file:{path}", path, language(path), text))
    return [f for f in got if not rules or f["rule"] in rules]


def keys(path, text, *rules):
    return [(f["role"], f["key"]) for f in facts(path, text, *rules)]


def test_languages():
    assert [language(p) for p in ("a/b.tsx", "b.d.ts", "x.py", "pom.xml", "noext", "A.JAVA")] == ["tsx", "typescript", "python", "xml", None, "java"]
    assert language("a.sql.ts", {".sql.ts": "sql"}) == "sql"


def test_source_blanks_comments_and_strings():
    s = Source('f("a // b", /* c(1) */ g(2)) // h(3)\nk("x")')
    assert [(c.name, c.args, c.line) for c in s.calls] == [("f", ['"a // b"', "g(2)"], 1), ("g", ["2"], 1), ("k", ['"x"'], 2)]
    assert members("{ url: '/a', method: \"POST\", run() { return 1; }, short }") == {"url": "'/a'", "method": '"POST"', "run": "run() { return 1; }", "short": "short"}
    assert value("BASE + '/x'", {"BASE": "/b"}) == "/b/x" and value("`/u/${user.id}/${BASE}`", {"BASE": "q"}) == "/u/${id}/q" and value("a + '/x'", {}) is None


SCRIPT = '''import http, { apiGet as get } from "./request";
export * from "./other";
const API = "/api/items";
/** Loads. */
export async function load(id) {
  await fetch(`/api/users/${id}`);
  await http.post(API + "/new", {});
  axios.request({ url: "/plain", method: "put" });
  client.get(buildUrl());
  return apiDelete("/gone/:id");
}
class Shop extends Base {
  open(name) { return call("/api/inside"); }
}
const arrow = (x) => x + 1;
'''


def test_script_parsing_and_http():
    p = parse(SCRIPT, "typescript", "src/a.ts")
    assert [(i["module"], [b["local"] for b in i["bindings"]]) for i in p["imports"]] == [("./request", ["http", "get"]), ("./other", ["*"])]
    assert [(s["kind"], s["qualified_name"], s["start_line"], s["end_line"]) for s in p["symbols"]] == [("class", "Shop", 12, 14), ("method", "Shop.open", 13, 13), ("function", "load", 5, 11), ("function", "arrow", 15, 15)]
    assert p["symbols"][2]["summary"] == "Loads."
    assert keys("src/a.ts", SCRIPT, "http-client-api-consumer", "http-client-object-url-consumer") == [("consumer", "GET:/api/users/{id}"), ("consumer", "POST:/api/items/new"), ("consumer", "PUT:/plain"), ("consumer", "DELETE:/gone/{id}")]
    assert [f["rule"] for f in facts("src/a.ts", SCRIPT) if f["confidence"] == 0] == ["dynamic-unresolved"]
    assert keys("src/a.ts", SCRIPT, "api-path-consumer") == [("consumer", "/api/items"), ("consumer", "/api/inside")] or keys("src/a.ts", SCRIPT, "api-path-consumer") == [("consumer", "/api/inside")]


def test_vue_keeps_lines():
    text = "<template>\n<p/>\n</template>\n<script setup lang=\"ts\">\nconst f = () => fetch('/api/v')\n</script>"
    assert vue_script(text).count("\n") == text.count("\n")
    assert [(f["key"], f["line"]) for f in facts("a.vue", text, "http-client-api-consumer")] == [("GET:/api/v", 5)]


def test_js_events_need_a_broker_for_common_verbs():
    text = 'import { Kafka } from "kafkajs";\nproducer.send("Order.Created", new OrderEvent());\nbus.subscribe("b", (m: Msg) => m);\n'
    got = [(f["key"], f["role"], json.loads(f["spec"]).get("payloadType"), json.loads(f["spec"])["broker"]) for f in facts("e.ts", text, "event-publisher", "event-consumer")]
    assert got == [("order.created", "producer", "OrderEvent", "kafka"), ("b", "consumer", "Msg", "kafka")]
    assert not facts("e.ts", 'res.send("ok"); socket.on("x", f); process.emit("y")', "event-publisher", "event-consumer")
    assert keys("e.ts", 'bus.publish<Made>("made", x)', "event-publisher") == [("producer", "made")]


def test_ts_schemas():
    text = "export interface OrderDto {\n  id: string;\n  lines?: Line[]\n  when: Date | null;\n}\nexport type PartSchema = Omit<OrderDto, 'id'>;\nenum Color { Red }\ninterface Other { a: string }\n"
    got = {f["key"]: f for f in facts("s.ts", text, "ts-schema-fields")}
    assert [(x["name"], x["type"], x["optional"]) for x in json.loads(got["OrderDto"]["spec"])["fields"]] == [("id", "string", False), ("lines", "array<Line>", True), ("when", "date", False)]
    assert got["PartSchema"]["refs"] == ["USES_SCHEMA:OrderDto"] and len(got) == 2
    assert keys("s.ts", text, "enum-symbol") == [("shared", "Color")]


def test_js_grpc_and_sdk():
    text = 'import * as grpc from "@grpc/grpc-js";\nserver.addService(pb.OrderService.service, { getOrder: (call, cb) => { call.write(1); } });\nconst client = new pb.OrderServiceClient(addr);\nclient.getOrder(new GetRequest(), cb);\n'
    got = [(f["role"], f["key"], json.loads(f["spec"])["streaming"], json.loads(f["spec"]).get("requestType")) for f in facts("g.ts", text, "js-grpc-server", "js-grpc-client")]
    assert got == [("producer", "OrderService/GetOrder", "server-stream", None), ("consumer", "OrderService/GetOrder", "unary", "GetRequest")]
    sdk = "export class OrderClient {\n  list(id) { return this.http.get(`/orders/${id}`); }\n}\nconst c = new OrderClient();\nc.list(1);\n"
    assert [(f["role"], f["key"], f["name"]) for f in facts("sdk.ts", sdk, "sdk-method", "sdk-call")] == [("mapping", "OrderClient.list", "GET:/orders/{id}"), ("call", "OrderClient.list", "OrderClient.list")]


PYTHON = '''from fastapi import APIRouter
import httpx
from dataclasses import dataclass
from kafka import KafkaProducer
from .models import Base

@router.get("/api/orders/{id}")
def show(id):
    """Shows."""
    httpx.post("/api/stock", json={})
    requests.get(url_for(id))
    cache.get("/api/not-http")
    return "/api/literal"

def publish(producer):
    producer.send("order.created", b"")

@dataclass
class OrderDto(Base):
    id: str
    note: str | None = None
    tags: list[int] = None
'''


def test_python():
    assert keys("svc/a.py", PYTHON, "python-decorator-producer", "python-http-client-consumer", "python-api-path-consumer") == [("producer", "GET:/api/orders/{id}"), ("consumer", "POST:/api/stock"), ("consumer", "/api/literal")]
    assert [f["line"] for f in facts("svc/a.py", PYTHON, "dynamic-unresolved")] == [11]
    assert keys("svc/a.py", PYTHON, "python-event-producer") == [("producer", "order.created")]
    dto = facts("svc/a.py", PYTHON, "python-schema-fields")[0]
    assert [(x["name"], x["type"], x["nullable"]) for x in json.loads(dto["spec"])["fields"]] == [("id", "string", False), ("note", "string", True), ("tags", "array<number>", False)] and dto["refs"] == ["USES_SCHEMA:Base"]
    p = parse(PYTHON, "python", "svc/a.py")
    assert p["imports"][-1]["module"] == "svc.models" and [s["qualified_name"] for s in p["symbols"]] == ["show", "publish", "OrderDto"] and p["symbols"][0]["summary"] == "Shows."
    assert facts("bad.py", "def (") == []
    celery = "from celery import shared_task\n@shared_task\ndef mail():\n    pass\n"
    assert keys("t.py", celery, "python-celery-task") == [("consumer", "mail")]


def test_python_grpc():
    text = "class Orders(pb_grpc.OrderServiceServicer):\n    def Get(self, request, context):\n        return 1\n    def Watch(self, request_iterator, context):\n        yield 1\n\ndef run(ch):\n    stub = pb_grpc.OrderServiceStub(ch)\n    stub.Get(pb.GetRequest())\n"
    got = [(f["role"], f["key"], json.loads(f["spec"])["streaming"]) for f in facts("g.py", text, "python-grpc-server", "python-grpc-client")]
    assert got == [("producer", "OrderService/Get", "unary"), ("producer", "OrderService/Watch", "bidi-stream"), ("consumer", "OrderService/Get", "unary")]


JAVA = '''package com.shop.api;
import com.shop.dto.OrderDto;
import static com.shop.Util.help;
import org.springframework.kafka.core.KafkaTemplate;
@RestController
@RequestMapping("/api/orders")
public class OrderController {
  @DubboReference(group = "g", version = "1.0")
  private StockService stock;
  @GetMapping("/list")
  public List<OrderDto> list() { return stock.find(new Query()); }
  @PostMapping
  public Object make(@RequestBody OrderDto dto) { kafkaTemplate.send("order.made", dto); return null; }
  @RequestMapping(value = "/x", method = RequestMethod.PUT)
  public void x() {}
  @KafkaListener(topics = {"a.b", "${topic}"})
  public void on(String m) {}
}
class Plain { @GetMapping("/no") void no() {} }
'''


def test_java():
    got = [(f["key"], json.loads(f["spec"]).get("requestBodyType"), json.loads(f["spec"]).get("responseBodyType")) for f in facts("src/main/java/com/shop/api/OrderController.java", JAVA, "spring-mvc-mapping")]
    assert got == [("GET:/api/orders/list", None, "OrderDto"), ("POST:/api/orders", "OrderDto", None), ("PUT:/api/orders/x", None, None)]
    assert keys("A.java", JAVA, "java-event-listener", "java-event-producer") == [("consumer", "a.b"), ("producer", "order.made")]
    dub = facts("A.java", JAVA, "java-dubbo-reference")[0]
    assert dub["key"] == "com.shop.api.stockservice#find" and json.loads(dub["spec"])["group"] == "g" and json.loads(dub["spec"])["requestTypes"] == ["Query"]
    assert keys("A.java", JAVA, "import-specifier-package-owner") == [("consumer", "com.shop.dto"), ("consumer", "com.shop"), ("consumer", "org.springframework.kafka.core")]
    assert keys("A.java", JAVA, "java-package-path") == [("owner", "com.shop.api")] and keys("src/main/java/x/y/Z.java", "class Z {}", "java-package-path") == [("owner", "x.y")]


def test_java_services_and_schemas():
    text = 'package p;\n@DubboService(version = "2")\npublic class Impl implements Other, StockService {\n  public Item find(Query q, int n) { return null; }\n}\nclass G extends OrderGrpc.OrderImplBase {\n  @Override\n  public void getOrder(GetRequest r, StreamObserver<Order> o) { }\n}\n@Data\nclass ItemDTO extends BaseDTO {\n  private String name;\n  private List<Integer> sizes;\n  static int n = 1;\n}\nclass Use { OrderGrpc.OrderBlockingStub stub; void f() { stub.getOrder(r); } }\n'
    dub = facts("A.java", text, "java-dubbo-service")
    assert [(f["key"], json.loads(f["spec"])["requestTypes"], json.loads(f["spec"])["responseType"]) for f in dub] == [("p.stockservice#find", ["Query", "int"], "Item")]
    assert keys("A.java", text, "java-grpc-server", "java-grpc-client") == [("producer", "Order/GetOrder"), ("consumer", "Order/GetOrder")]
    dto = facts("A.java", text, "java-schema-fields")[0]
    assert [(x["name"], x["type"]) for x in json.loads(dto["spec"])["fields"]] == [("name", "string"), ("sizes", "array<number>")] and dto["framework"] == "lombok" and dto["refs"] == ["USES_SCHEMA:BaseDTO"]


def test_go():
    text = 'package main\nimport (\n  "net/http"\n  n "github.com/nats-io/nats.go"\n)\nfunc (s *Server) Start() {\n  http.HandleFunc("/api/info", s.info)\n  r.GET("/api/users", f)\n  http.Get("/api/orders")\n  http.Get(buildURL())\n  cache.Get("/api/local/cache")\n  nc.Publish("order.created", x)\n}\ntype CreateDTO struct {\n  Base\n  Name *string `json:"name,omitempty"`\n  Tags []string\n}\n'
    assert keys("m.go", text, "go-route-producer", "go-http-client-consumer") == [("producer", "/api/info"), ("producer", "GET:/api/users"), ("consumer", "GET:/api/orders")]
    assert len(facts("m.go", text, "dynamic-unresolved")) == 1 and keys("m.go", text, "go-event-producer") == [("producer", "order.created")]
    dto = facts("m.go", text, "go-schema-fields")[0]
    assert [(x["name"], x["type"], x["nullable"]) for x in json.loads(dto["spec"])["fields"]] == [("name", "string?", True), ("Tags", "array<string>", False)] and dto["refs"] == ["USES_SCHEMA:Base"]
    assert [s["qualified_name"] for s in parse(text, "go", "m.go")["symbols"]] == ["Server.Start", "CreateDTO"]
    kafka = 'import "github.com/segmentio/kafka-go"\nfunc f() { w.Write(kafka.Message{Topic: "a.b"}); w.Write(kafka.Message{Topic: t}); r.Subscribe("x", h) }\n'
    assert [(f["key"], f["rule"]) for f in facts("k.go", kafka) if "event" in f["rule"]] == [("a.b", "go-event-producer"), ("", "event-topic-unresolvable")]
    grpc = 'type server struct {\n  pb.UnimplementedOrderServer\n}\nfunc (s *server) Get(ctx context.Context, in *pb.GetRequest) (*pb.Order, error) { return nil, nil }\nfunc g() { c := pb.NewOrderClient(conn); c.Get(ctx, &pb.GetRequest{}) }\n'
    assert keys("g.go", grpc, "go-grpc-server", "go-grpc-client") == [("producer", "Order/Get"), ("consumer", "Order/Get")]


def test_definitions():
    proto = 'syntax = "proto3";\npackage shop.v1;\nservice Orders {\n  rpc Get (GetRequest) returns (Order);\n  rpc Watch (stream GetRequest) returns (stream Order) {}\n}\nmessage Order {\n  string id = 1;\n  repeated Line lines = 2;\n  map<string, int32> n = 3;\n  message Line { optional int32 qty = 1; }\n}\n'
    got = [(f["key"], json.loads(f["spec"])["streaming"]) for f in facts("a.proto", proto, "proto-rpc")]
    assert got == [("shop.v1.Orders/Get", "unary"), ("shop.v1.Orders/Watch", "bidi-stream")]
    got = {f["key"]: [(x["name"], x["type"]) for x in json.loads(f["spec"])["fields"]] for f in facts("a.proto", proto, "proto-schema")}
    assert got == {"shop.v1.Order": [("id", "string"), ("lines", "array<Line>"), ("n", "map<string, int32>")], "shop.v1.Order.Line": [("qty", "number")]}
    xml = '<beans>\n<dubbo:service interface="a.B" ref="x" group="g"/>\n<dubbo:reference id="y" interface=\'a.C\' version="2" />\n</beans>'
    assert [(f["role"], f["key"], f["line"]) for f in facts("d.xml", xml)] == [("producer", "a.b#*", 2), ("consumer", "a.c#*", 3)]
    sdl = 'type Query {\n  order(id: ID!): Order # one\n  all: [Order!]!\n}\n"""Doc { x }"""\ntype Order { id: ID! note: String }\ninput In { a: Int }\n'
    got = {f["key"]: f for f in facts("s.graphql", sdl)}
    assert set(got) == {"query.order", "query.all", "Query", "Order", "In"} and got["query.order"]["refs"] == ["RESPONSE_SCHEMA:Order", "REQUEST_SCHEMA:ID"] and got["query.all"]["role"] == "shared"
    client = "const Q = gql`\n  query One($id: ID!) { order(id: $id) { id } other: all { id } }\n`"
    assert [(f["role"], f["key"], f["line"]) for f in facts("c.ts", client, "graphql-client-template")] == [("consumer", "query.order", 2), ("consumer", "query.all", 2)]


def test_configuration_and_packages():
    assert [k for _, k in keys("a.yaml", "server:\n  port: 1\nname: x\n")] == ["server.port", "name"]
    assert [k for _, k in keys("a.toml", "[db]\nurl = 1\n")] == ["db.url"] and [k for _, k in keys("a.properties", "# c\nspring.name=x\nother: y\n")] == ["spring.name", "other"]
    assert keys("broken.yaml", "a: [") == []
    assert [k for _, k in keys("e.ts", 'process.env.API_KEY; process.env["DB_URL"]; process.env.x; config.get("app.port"); // process.env.NOT_ME', "config-key-reference")] == ["API_KEY", "DB_URL", "app.port"]
    manifest = '{\n "name": "@s/web",\n "dependencies": {"axios": "1"},\n "devDependencies": {"vitest": "2"}\n}'
    assert [(f["role"], f["key"], f["line"]) for f in facts("web/package.json", manifest)] == [("owner", "@s/web", 2), ("consumer", "axios", 3), ("consumer", "vitest", 4)]
    assert facts("package.json", "{broken") == [] and facts("other.json", manifest) == []


def test_csharp():
    text = '[ApiController]\n[Route("api/[controller]")]\npublic class OrdersController {\n  [HttpGet("{id:int}")] public Order Get(int id) => null;\n}\npublic class OrderDto { public string Name { get; set; } public int? Count { get; set; } }\napp.MapPost("/min", f);\nawait client.GetAsync("/api/stock");\nawait producer.ProduceAsync("order.made", m);\n'
    assert keys("A.cs", text, "csharp-controller-route", "csharp-minimal-api", "csharp-http-client") == [("producer", "GET:/api/orders/{id}"), ("producer", "POST:/min"), ("consumer", "GET:/api/stock")]
    assert keys("A.cs", text, "csharp-event-producer") == [("producer", "order.made")] and [(x["name"], x["optional"]) for x in json.loads(facts("A.cs", text, "csharp-schema-fields")[0]["spec"])["fields"]] == [("Name", False), ("Count", True)]
    assert keys("A.csproj", '<PackageReference Include="Kafka" Version="1"/>') == [("consumer", "Kafka")]


@pytest.mark.parametrize("path", ["a.ts", "a.py", "A.java", "a.go", "a.proto", "a.graphql", "a.xml", "package.json", "a.yaml", "a.vue", "A.cs"])
@pytest.mark.parametrize("text", ["", "{" * 50, "(" * 50 + '"', "class X {", "\x00�\n" * 3, "import x from 'y'; f(" * 20])
def test_broken_sources_give_no_error(path, text):
    facts(path, text)
