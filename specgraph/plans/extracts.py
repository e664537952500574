"""One query for each contract reader: sources made of every supplier (its key for §), and the facts that they hold, written out."""

from __future__ import annotations

from pyspark.sql import functions as F

from specgraph.extraction import run as X
from specgraph.extraction.parse import language
from specgraph.sources import projection as P

#: name: path, source, expected (kind, key, role, rule, line, confidence).
CASES = {
    "extract_package_json": ("package.json", '{\n  "name": "@s/p-§",\n  "dependencies": {"axios": "1", "lib-§": "2"},\n  "devDependencies": {"vitest": "3"}\n}\n', [("package", "@s/p-§", "owner", "package-json-name", 2, 1.0), ("package", "axios", "consumer", "package-json-dependency", 3, 1.0), ("package", "lib-§", "consumer", "package-json-dependency", 3, 1.0), ("package", "vitest", "consumer", "package-json-dependency", 4, 1.0)]),
    "extract_js_http": ("src/client.js", 'const BASE = "/api/v§";\nfunction load(id) {\n  fetch(`/api/users/${id}`);\n  axios.post(BASE + "/orders", {});\n  request({ url: "/plain/§", method: "put" });\n  client.get(build());\n}\n', [("api", "GET:/api/users/{id}", "consumer", "http-client-api-consumer", 3, 0.85), ("api", "POST:/api/v§/orders", "consumer", "http-client-api-consumer", 4, 0.85), ("api", "PUT:/plain/§", "consumer", "http-client-object-url-consumer", 5, 0.85), ("", "", "", "dynamic-unresolved", 6, 0.0)]),
    "extract_js_events": ("src/bus.js", "// kafka\nproducer.send('never.§');\nkafkaProducer.send('Order.§', x => x);\nbus.publish('made.§', { a: 1 });\nbus.subscribe('seen.§', f);\n", [("event", "order.§", "producer", "event-publisher", 3, 0.85), ("event", "made.§", "producer", "event-publisher", 4, 0.85), ("event", "seen.§", "consumer", "event-consumer", 5, 0.85), ("", "", "", "payload-type-unresolvable", 3, 0.0)]),
    "extract_ts_schema": ("src/dto.ts", "export interface Order§Dto {\n  id: string;\n  n?: number;\n}\nexport type Part§Schema = Pick<Order§Dto, 'id'>;\nexport enum Color§ { Red }\n", [("dto", "Order§Dto", "shared", "ts-schema-fields", 1, 0.75), ("schema", "Part§Schema", "shared", "ts-schema-fields", 5, 0.75), ("enum", "Color§", "shared", "enum-symbol", 6, 0.75)]),
    "extract_proto": ("a.proto", 'syntax = "proto3";\npackage Shop.v§;\nservice Orders {\n  rpc Get (Req) returns (stream Res);\n}\nmessage Req {\n  string id = 1;\n}\n', [("grpc", "shop.v§.Orders/Get", "shared", "proto-rpc", 4, 1.0), ("schema", "Shop.v§.Req", "shared", "proto-schema", 6, 1.0)]),
    "extract_dubbo_xml": ("d.xml", '<beans>\n<dubbo:service interface="a.S§" ref="x"/>\n<dubbo:reference id="y" interface="b.R§" version="2"/>\n</beans>\n', [("dubbo", "a.s§#*", "producer", "dubbo-xml-service", 2, 0.9), ("dubbo", "b.r§#*", "consumer", "dubbo-xml-reference", 3, 0.9)]),
    "extract_graphql_sdl": ("s.graphql", "type Query {\n  order§(id: ID!): Order§\n}\ntype Order§ {\n  id: ID!\n}\n", [("graphql", "query.order§", "shared", "graphql-sdl-operation", 2, 1.0), ("schema", "Query", "shared", "graphql-schema-type", 1, 1.0), ("schema", "Order§", "shared", "graphql-schema-type", 4, 1.0)]),
    "extract_graphql_client": ("q.js", "const q = gql`\n  query Q { order§ { id } }\n`;\n", [("graphql", "query.order§", "consumer", "graphql-client-template", 2, 0.85)]),
    "extract_python_http": ("app.py", 'import httpx\n\n@router.get("/api/o/{id}")\ndef show(id):\n    httpx.post("/api/s§")\n    requests.get(url(id))\n    return "/api/lit§"\n', [("api", "GET:/api/o/{id}", "producer", "python-decorator-producer", 3, 0.9), ("api", "POST:/api/s§", "consumer", "python-http-client-consumer", 5, 0.85), ("", "", "", "dynamic-unresolved", 6, 0.0), ("api", "/api/lit§", "consumer", "python-api-path-consumer", 7, 0.8), ("package", "httpx", "consumer", "import-specifier-package-owner", 1, 0.9)]),
    "extract_python_events": ("ev.py", "import pika\n\ndef go(ch):\n    ch.basic_publish(exchange='', routing_key='made.§', body=b'')\n    ch.basic_consume(queue='seen.§')\n", [("event", "made.§", "producer", "python-event-producer", 4, 0.85), ("event", "seen.§", "consumer", "python-event-consumer", 5, 0.85), ("package", "pika", "consumer", "import-specifier-package-owner", 1, 0.9)]),
    "extract_python_schema": ("dto.py", "class Order§Dto(BaseModel):\n    id: str\n    n: int | None = None\n", [("dto", "Order§Dto", "shared", "python-schema-fields", 1, 0.75)]),
    "extract_python_grpc": ("g.py", "class S(pb.Svc§Servicer):\n    def Get(self, request, context):\n        return 1\n\ndef run(c):\n    stub = pb.Other§Stub(c)\n    stub.Do(1)\n", [("grpc", "Svc§/Get", "producer", "python-grpc-server", 2, 0.9), ("grpc", "Other§/Do", "consumer", "python-grpc-client", 7, 0.9)]),
    "extract_spring": ("A.java", 'package p§;\n@RestController\n@RequestMapping("/api/v§")\npublic class A {\n  @GetMapping("/list")\n  public Object list() { return null; }\n  @RequestMapping(value = "/x", method = RequestMethod.PUT)\n  public void x() { }\n}\n', [("api", "GET:/api/v§/list", "producer", "spring-mvc-mapping", 5, 0.9), ("api", "PUT:/api/v§/x", "producer", "spring-mvc-mapping", 7, 0.9), ("package", "p§", "owner", "java-package-path", 1, 0.8)]),
    "extract_java_events": ("L.java", 'import org.springframework.kafka.K;\nclass L {\n  @KafkaListener(topics = {"a.§", "${t}"})\n  void on(String m) { kafkaTemplate.send("b.§", m); }\n}\n', [("event", "a.§", "consumer", "java-event-listener", 3, 0.9), ("event", "b.§", "producer", "java-event-producer", 4, 0.85), ("package", "org.springframework.kafka", "consumer", "import-specifier-package-owner", 1, 0.9)]),
    "extract_java_dubbo": ("D.java", 'package q;\n@DubboService(group = "g")\npublic class D implements Stock§Service {\n  public Item find(Query k) { return null; }\n}\nclass U {\n  @DubboReference\n  private Order§Service orders;\n  void go() { orders.get(1); }\n}\n', [("dubbo", "q.stock§service#find", "producer", "java-dubbo-service", 4, 0.9), ("dubbo", "q.order§service#get", "consumer", "java-dubbo-reference", 9, 0.9), ("package", "q", "owner", "java-package-path", 1, 0.8)]),
    "extract_java_schema": ("B.java", "class Item§DTO extends BaseDTO {\n  private String name;\n}\n", [("dto", "Item§DTO", "shared", "java-schema-fields", 1, 0.75)]),
    "extract_java_grpc": ("G.java", "class G extends SvcGrpc.Svc§ImplBase {\n  @Override\n  public void getOne(Req r, StreamObserver<Res> o) { }\n}\nclass C {\n  Svc§BlockingStub stub;\n  void go() { stub.getTwo(r); }\n}\n", [("grpc", "Svc§/GetOne", "producer", "java-grpc-server", 3, 0.9), ("grpc", "Svc§/GetTwo", "consumer", "java-grpc-client", 7, 0.9)]),
    "extract_go_http": ("m.go", 'package main\nfunc run() {\n  http.HandleFunc("/api/i§", f)\n  r.GET("/api/u§", f)\n  http.Get("/api/o§")\n  http.Get(build())\n}\n', [("api", "/api/i§", "producer", "go-route-producer", 3, 0.9), ("api", "GET:/api/u§", "producer", "go-route-producer", 4, 0.9), ("api", "GET:/api/o§", "consumer", "go-http-client-consumer", 5, 0.85), ("", "", "", "dynamic-unresolved", 6, 0.0)]),
    "extract_go_events": ("n.go", 'package main\nimport "github.com/nats-io/nats.go"\nfunc run() {\n  nc.Publish("made.§", x)\n  nc.Subscribe("seen.§", f)\n}\n', [("event", "made.§", "producer", "go-event-producer", 4, 0.85), ("event", "seen.§", "consumer", "go-event-consumer", 5, 0.85), ("package", "github.com/nats-io/nats.go", "consumer", "import-specifier-package-owner", 2, 0.9)]),
    "extract_go_schema": ("s.go", "package main\ntype Order§DTO struct {\n  Base\n  Name string\n}\n", [("dto", "Order§DTO", "shared", "go-schema-fields", 2, 0.75)]),
    "extract_go_grpc": ("h.go", "package main\ntype server struct {\n  pb.UnimplementedSvc§Server\n}\nfunc (s *server) Get(c ctx, in *pb.Req) (*pb.Res, error) { return nil, nil }\nfunc g() {\n  k := pb.NewOther§Client(conn)\n  k.Do(c)\n}\n", [("grpc", "Svc§/Get", "producer", "go-grpc-server", 5, 0.9), ("grpc", "Other§/Do", "consumer", "go-grpc-client", 8, 0.9)]),
    "extract_js_grpc": ("srv.js", 'const grpc = require("@grpc/grpc-js");\nserver.addService(pb.Svc§.service, { getOne: f });\nconst c = new pb.Other§Client(a);\nc.run(1);\n', [("grpc", "Svc§/GetOne", "producer", "js-grpc-server", 2, 0.9), ("grpc", "Other§/Run", "consumer", "js-grpc-client", 4, 0.9), ("package", "@grpc/grpc-js", "consumer", "import-specifier-package-owner", 1, 0.9)]),
    "extract_config": ("app.properties", "# c\nspring.name=x\nkey§.b: y\n", [("config", "spring.name", "shared", "config-file-key", 2, 0.75), ("config", "key§.b", "shared", "config-file-key", 3, 0.75)]),
    "extract_env": ("env.js", "const a = process.env.API_§;\nconst b = config.get('app.k§');\nconst c = process.env.x;\n", [("config", "API_§", "shared", "config-key-reference", 1, 0.7), ("config", "app.k§", "shared", "config-key-reference", 2, 0.7)]),
    "extract_csharp": ("O.cs", '[Route("api/[controller]")]\npublic class Orders§Controller {\n  [HttpGet("{id:int}")] public int Get(int id) => 1;\n}\napp.MapPost("/min§", f);\n', [("api", "GET:/api/orders§/{id}", "producer", "csharp-controller-route", 3, 0.9), ("api", "POST:/min§", "producer", "csharp-minimal-api", 5, 0.9)]),
}
def _query(path: str, source: str):
    def run(spark, d):
        key = F.col("s_suppkey").cast("string")
        files = P.table(spark, d, "supplier").select(F.concat(F.lit("repo:"), key).alias("repo_id"), F.concat(F.lit("f:"), key).alias("file_id"), F.lit(path).alias("path"), F.lit(language(path)).alias("language"), F.replace(F.lit(source), F.lit("§"), key).alias("source"))
        return X.facts(files).select("repo_id", "kind", "key", "role", "rule", F.col("line").cast("long").alias("line"), "confidence")

    return run


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql(rows: list[tuple]) -> str:
    values = ", ".join(f"({_quoted(kind)}, {_quoted(key)}, {_quoted(role)}, {_quoted(rule)}, {line}, {confidence})" for kind, key, role, rule, line, confidence in rows)
    return f"SELECT 'repo:' || s_suppkey AS repo_id, kind, replace(key, '§', s_suppkey::VARCHAR) AS key, role, rule, line::BIGINT AS line, confidence::DOUBLE AS confidence FROM supplier, (VALUES {values}) AS v(kind, key, role, rule, line, confidence)"


QUERIES = {name: _query(path, source) for name, (path, source, _) in CASES.items()}
ORACLES = {name: _sql(rows) for name, (_, _, rows) in CASES.items()}
