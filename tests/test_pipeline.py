import json

from corpusloom.plans import pipeline

SHOP = """package shop;
import org.springframework.web.bind.annotation.*;
@RestController @RequestMapping("/orders")
public class OrderController {
  private OrderService service;
  @GetMapping("/{id}") public String find(@PathVariable Long id) { return service.load(id); }
  @PostMapping public void add(@RequestBody Order o) { service.save(o); service.unknown(o); }
}
"""
SERVICE = """package shop;
import org.springframework.stereotype.Service;
@Service
public class OrderService {
  private OrderRepo repo; private RestTemplate restTemplate; private KafkaTemplate<String, String> kafkaTemplate;
  public String load(Long id) { return repo.findById(id); }
  public void save(Order o) { jdbcTemplate.update("INSERT INTO orders VALUES (?)", o); kafkaTemplate.send("orders", "x"); restTemplate.getForObject("/stock/7", String.class); }
}
"""
REPO = """package shop;
import org.springframework.data.jpa.repository.JpaRepository;
public interface OrderRepo extends JpaRepository<Order, Long> { String findById(Long id); }
"""
STOCK = """package stock;
@RestController public class StockController {
  @GetMapping("/stock/{sku}") public String one(@PathVariable String sku) { return "ok"; }
}
"""
LISTENER = """package stock;
public class OrderListener { @KafkaListener(topics = "orders, returns") public void on(String m) { log(m); } void log(String m) {} }
"""


def corpus(tmp_path):
    root = tmp_path / "src"
    for name, body in {"shop/OrderController": SHOP, "shop/OrderService": SERVICE, "shop/OrderRepo": REPO, "stock/StockController": STOCK, "stock/OrderListener": LISTENER, "shop/Broken": "class { ]", "target/Skipped": SHOP, "shop/OrderServiceTest": "package shop; class OrderServiceTest {}"}.items():
        p = root / f"{name}.java"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    (root / "page.jsp").write_text('<form action="/orders/7" method="get"><input name="q"></form><a href="/orders/9">x</a>')
    manifest = tmp_path / "manifest.yaml"
    manifest.write_text(f"targets:\n  - name: main\n    path: {root}\n")
    return root, manifest


def test_whole_run(spark, tmp_path):
    root, manifest = corpus(tmp_path)
    paths = pipeline.run_all(spark, str(manifest), str(tmp_path / "state"), str(tmp_path / "out"), "2026-01-01T00:00:00")
    ws = pipeline.Workspace(spark, str(tmp_path / "state"))
    tasks = {r.file_path.rsplit("/", 1)[-1]: r.status for r in ws.read("tasks").collect()}
    assert "Skipped.java" not in tasks and tasks["Broken.java"] == "SKIPPED"
    assert tasks["OrderService.java"] == "ENRICHED"  # a paired test
    edges = {(r.source_class, r.source_method, r.target_class, r.target_method): r.resolved_status for r in ws.read("call_edges").collect()}
    assert edges["OrderController", "find", "OrderService", "load"] == "RESOLVED"
    assert edges["OrderController", "add", "OrderService", "unknown"] == "UNRESOLVED"
    assert [(r.topic, r.status) for r in ws.read("topic_links").collect()] == [("orders", "RESOLVED")]
    link = ws.read("floating_links").collect()
    assert [(r.endpoint, r.status) for r in link] == [("/stock/{sku}", "RESOLVED")]
    forms = {(r.form_action, r.endpoint, r.confidence) for r in ws.read("template_links").collect()}
    assert forms == {("/orders/7", "/orders/{id}", 0.8), ("/orders/9", "/orders/{id}", 0.8)}
    steps = [(r.component_type, r.method_name) for r in ws.read("flow_steps").where("flow_id LIKE 'HTTP:GET:/orders%' AND NOT unresolved").orderBy("step_index").collect()]
    assert steps == [("REST_ENDPOINT", "find"), ("SERVICE", "load"), ("DATABASE", "findById")]
    related = {(r.source_flow.split(":")[1], r.target_flow.split(":")[0], r.type) for r in ws.read("relationships").collect()}
    assert ("POST", "KAFKA", "PUBLISHES_EVENT") in related and ("POST", "HTTP", "CALLS_EXTERNAL") in related
    spec, manifest_json, index = paths
    assert "## Orders" in open(spec).read()
    assert json.load(open(manifest_json))["version"] == "3.0.0"
    found = json.load(open(index))
    assert found["targets"][0]["name"] == "main" and len(found["targets"][0]["endpoints"]) == 3
    counts, hint = pipeline.status(ws)
    assert hint == "generate"


def test_resume_reads_changed_files_alone(spark, tmp_path):
    root, manifest = corpus(tmp_path)
    from corpusloom.sources import files

    ws = pipeline.Workspace(spark, str(tmp_path / "state"))
    targets = files.targets_of(files.parse_manifest(manifest.read_text()))
    first = pipeline.scan(ws, targets)
    (root / "stock/OrderListener.java").write_text(LISTENER.replace("orders, returns", "returns"))
    second = pipeline.scan(ws, targets, resume=True)
    assert ws.read("scanned").count() == 1
    assert second["files"] == first["files"] + 1  # the old version's task stays as history
    assert {(r.topic, r.status) for r in ws.read("topic_links").collect()} == {("orders", "PENDING"), ("returns", "PENDING")}
    assert second["edges_resolved"] == first["edges_resolved"]
