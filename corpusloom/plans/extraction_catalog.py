"""Queries of the extractors: sources are made from whole tables by templates, and the SQL says which facts they hold.

Each supplier is one file, with its key in class names, paths and topics, so a fact that
is lost, doubled or mixed up between files shows in the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.extract import markup, run
from corpusloom.operators import flows
from corpusloom.plans.registry import joined, query, table


def sources(spark, sf, template: str, path: str = "src/main/java/shop/S@k@.java") -> DataFrame:
    """(path, content): one file per supplier; @k@ and @n@ stand for its key and its nation.

    Keys are dealt out first: a file takes milliseconds to parse, but a single task reads
    the keys of very many files.
    """
    fill = lambda text: F.replace(F.replace(F.lit(text), F.lit("@k@"), F.col("s_suppkey").cast("string")), F.lit("@n@"), F.col("s_nationkey").cast("string"))
    keys = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey").repartition(2 * spark.sparkContext.defaultParallelism, "s_suppkey")
    return keys.select(fill(path).alias("path"), fill(template).alias("content"))


def relation(spark, sf, template: str, kind: str) -> DataFrame:
    return run.relation(run.extract(sources(spark, sf, template)), kind)


def expected(names: str, *rows: str) -> str:
    """SQL: the rows, each of comma-joined expressions over a supplier (k, n), for every supplier."""
    columns = names.split()
    one = lambda row: "SELECT " + ", ".join(f"{e} AS {c}" for e, c in zip(_parts(row), columns, strict=True)) + " FROM s"
    return "WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, CAST(s_nationkey AS VARCHAR) AS n FROM supplier) " + " UNION ALL ".join(map(one, rows))


def _parts(row: str) -> list[str]:
    """The expressions of a row, written with semicolons between."""
    return [p.strip() for p in row.split(";")]


# --- declarations, components, endpoints ------------------------------------------------------

DECLARED = """package shop.n@n@;
import lib.Base;
public class Supplier@k@ extends Base<String> implements Named {
  int stock;
  void load(int id, List<String> names) {
    stock = id;
  }
  interface Part@k@ { String name(); }
}
"""


@query(expected("class_name method_name params start_line end_line", "'Supplier' || k; '<clinit>'; ''; 3; 9", "'Supplier' || k; 'load'; 'int|List<String>'; 5; 7", "'Part' || k; '<clinit>'; ''; 8; 8", "'Part' || k; 'name'; ''; 8; 8"))
def extract_declarations(spark, sf):
    return relation(spark, sf, DECLARED, "declaration").select("class_name", "method_name", joined(F.col("param_types")).alias("params"), "start_line", "end_line")


@query(expected("class_name super_simple_name super_fqn", "'Supplier' || k; 'Base'; 'lib.Base'", "'Supplier' || k; 'Named'; 'shop.n' || n || '.Named'"))
def extract_supertypes(spark, sf):
    return relation(spark, sf, DECLARED, "supertype").select("class_name", "super_simple_name", "super_fqn")


COMPONENTS = """package shop.n@n@;
@Service class Plain@k@ {}
@Entity @Table(name = "t") class Row@k@ {}
@Deprecated class None@k@ {}
@RestController interface NotAClass@k@ {}
@Configuration class Config@k@ {
  @Bean Clock clock@k@() { return null; }
  @Bean(name = "timer@k@") Timer other() { return null; }
  String noBean() { return ""; }
}
"""


@query(expected("annotation_type class_name package_name", "'Service'; 'Plain' || k; 'shop.n' || n", "'Entity'; 'Row' || k; 'shop.n' || n"))
def extract_components(spark, sf):
    return relation(spark, sf, COMPONENTS, "component").select("annotation_type", "class_name", "package_name")


@query(expected("bean_name return_type configuration_class", "'clock' || k; 'Clock'; 'Config' || k", "'timer' || k; 'Timer'; 'Config' || k"))
def extract_bean_methods(spark, sf):
    return relation(spark, sf, COMPONENTS, "bean_method").select("bean_name", "return_type", "configuration_class")


ENDPOINTS = """@Controller @RequestMapping("/n@n@/")
class Orders@k@ {
  @GetMapping("/o@k@/{id}") public String show(@PathVariable("id") Long key, @RequestParam String q) { return view(); }
  private String view() { return "orders/@k@"; }
  @PostMapping(value = {"/a@k@", "b@k@"}) @ResponseBody public Order add(@RequestBody Order o) { return o; }
  @RequestMapping(path = "/r@k@", method = RequestMethod.PUT) public void put() { }
  public void helper() { }
}
"""
SERVLET = """@WebServlet(urlPatterns = {"/s@k@", "/t@k@"})
class Web@k@ extends HttpServlet {
  protected void doGet(HttpServletRequest a, HttpServletResponse b) { }
  protected void doPost(HttpServletRequest a, HttpServletResponse b) { }
  void doGet() { }
}
"""


@query(expected(
    "http_method path method_name path_variables query_parameters serves_view view_name request_bodies",
    "'GET'; '/n' || n || '/o' || k || '/{id}'; 'show'; 'id'; 'q'; true; 'orders/' || k; ''",
    "'POST'; '/n' || n || '/a' || k; 'add'; ''; ''; false; ''; 'Order'",
    "'POST'; '/n' || n || '/b' || k; 'add'; ''; ''; false; ''; 'Order'",
    "'PUT'; '/n' || n || '/r' || k; 'put'; ''; ''; true; ''; ''",
))
def extract_spring_endpoints(spark, sf):
    e = relation(spark, sf, ENDPOINTS, "endpoint")
    lists = [joined(F.col(c)).alias(c) for c in ("path_variables", "query_parameters", "request_bodies")]
    return e.select("http_method", "path", "method_name", "serves_view", "view_name", *lists)


@query(expected("http_method path controller_name method_name", *(f"'{v}'; '/{p}' || k; 'Web' || k; '{m}'" for v, m in (("GET", "doGet"), ("POST", "doPost")) for p in "st")))
def extract_servlet_endpoints(spark, sf):
    return relation(spark, sf, SERVLET, "endpoint").select("http_method", "path", "controller_name", "method_name")


WEB_XML = """<web-app xmlns="urn:w">
  <servlet><servlet-name>one</servlet-name><servlet-class>shop.One@k@</servlet-class></servlet>
  <servlet><servlet-name>unmapped</servlet-name><servlet-class>shop.None@k@</servlet-class></servlet>
  <servlet-mapping><servlet-name>one</servlet-name><url-pattern>/one/@k@</url-pattern><url-pattern>*.n@n@</url-pattern></servlet-mapping>
  <servlet-mapping><servlet-name>nobody</servlet-name><url-pattern>/x</url-pattern></servlet-mapping>
</web-app>"""


@query(expected("controller_name path", "'shop.One' || k; '/one/' || k", "'shop.One' || k; '*.n' || n"))
def extract_web_xml(spark, sf):
    return markup.apply(sources(spark, sf, WEB_XML, "web/@k@/web.xml"), markup.servlets, markup.SERVLET_SCHEMA).select("controller_name", "path")


# --- schedules, events, brokers, validators -------------------------------------------------------

SCHEDULES = """class Jobs@k@ {
  @Scheduled(cron = "0 @n@ * * * *") void nightly() { }
  @Scheduled(fixedRate = 5_000L) void often() { }
  @Scheduled(fixedDelay = @k@) void later() { }
  @Scheduled(initialDelay = 7) void odd() { }
}
"""


@query(expected(
    "class_name method_name type cron fixed_rate fixed_delay",
    "'Jobs' || k; 'nightly'; 'cron'; '0 ' || n || ' * * * *'; CAST(NULL AS BIGINT); CAST(NULL AS BIGINT)",
    "'Jobs' || k; 'often'; 'fixedRate'; NULL; 5000; NULL",
    "'Jobs' || k; 'later'; 'fixedDelay'; NULL; NULL; CAST(k AS BIGINT)",
    "'Jobs' || k; 'odd'; 'unknown'; NULL; NULL; NULL",
))
def extract_scheduled_tasks(spark, sf):
    return relation(spark, sf, SCHEDULES, "scheduled_task").select("class_name", "method_name", "type", "cron", "fixed_rate", "fixed_delay")


EVENTS = """class Events@k@ {
  private Mailer mailer;
  @EventListener void on(Paid@k@ event) { mailer.send(event.total()); note(); }
  @EventListener(classes = Closed@k@.class) void closed() { }
  void note() { publisher.publishEvent(new Noted@k@(1)); }
  void again(Held@k@ held) { publisher.publishEvent(held); }
}
"""


@query(expected("class_name method_name payload_type", "'Events' || k; 'on'; 'Paid' || k", "'Events' || k; 'closed'; 'Closed' || k"))
def extract_event_listeners(spark, sf):
    return relation(spark, sf, EVENTS, "event_listener").select("class_name", "method_name", "payload_type")


@query(expected("class_name event_type", "'Events' || k; 'Noted' || k", "'Events' || k; 'Held' || k"))
def extract_event_publishers(spark, sf):
    return relation(spark, sf, EVENTS, "event_publisher").select("class_name", "event_type")


@query(expected("method_name target_type called depth", "'on'; 'mailer'; 'send'; 1", "'on'; 'event'; 'total'; 2", "'on'; 'Events' || k; 'note'; 1"))
def extract_event_call_chains(spark, sf):
    return relation(spark, sf, EVENTS, "event_listener").select("method_name", F.explode("call_chain").alias("c")).select("method_name", "c.target_type", F.col("c.method_name").alias("called"), "c.depth")


BROKERS = """class Messages@k@ {
  @KafkaListener(topics = {"orders@k@", "returns"}) void a(Order o) { }
  @KafkaListener(topicPattern = "all.@k@.*") void b(String s) { }
  @RabbitListener(queues = "q@k@") void c(Order o) { }
  @JmsListener(destination = "d@k@") void d(String s) { }
  void send() {
    kafkaTemplate.send("orders@k@", x);
    rabbitTemplate.convertAndSend("ex@k@", "key@n@", x);
    rabbitTemplate.convertAndSend("fan@k@", x);
    jmsTemplate.convertAndSend("d@k@", x);
    other.send("nothing", x);
  }
}
"""


def _listeners(spark, sf, broker: str) -> DataFrame:
    found = relation(spark, sf, BROKERS, "broker_listener").where(F.col("broker") == broker)
    return found.select("class_name", "method_name", joined(F.col("topics")).alias("topics"), "is_pattern", "payload_type")


_LISTENER = "class_name method_name topics is_pattern payload_type"


@query(expected(_LISTENER, "'Messages' || k; 'a'; 'orders' || k || '|returns'; false; 'Order'", "'Messages' || k; 'b'; 'all.' || k || '.*'; true; 'String'"))
def extract_kafka_listeners(spark, sf):
    return _listeners(spark, sf, "KAFKA")


@query(expected(_LISTENER, "'Messages' || k; 'c'; 'q' || k; false; 'Order'"))
def extract_rabbit_listeners(spark, sf):
    return _listeners(spark, sf, "RABBITMQ")


@query(expected(_LISTENER, "'Messages' || k; 'd'; 'd' || k; false; 'String'"))
def extract_jms_listeners(spark, sf):
    return _listeners(spark, sf, "ACTIVEMQ")


def _publishers(spark, sf, broker: str) -> DataFrame:
    return relation(spark, sf, BROKERS, "broker_publisher").where(F.col("broker") == broker).select("class_name", "method_name", "topic", "exchange", "routing_key")


_PUBLISHER = "class_name method_name topic exchange routing_key"


@query(expected(_PUBLISHER, "'Messages' || k; 'send'; 'orders' || k; CAST(NULL AS VARCHAR); CAST(NULL AS VARCHAR)"))
def extract_kafka_publishers(spark, sf):
    return _publishers(spark, sf, "KAFKA")


@query(expected(_PUBLISHER, "'Messages' || k; 'send'; CAST(NULL AS VARCHAR); 'ex' || k; 'key' || n", "'Messages' || k; 'send'; NULL; 'fan' || k; ''"))
def extract_rabbit_publishers(spark, sf):
    return _publishers(spark, sf, "RABBITMQ")


@query(expected(_PUBLISHER, "'Messages' || k; 'send'; 'd' || k; CAST(NULL AS VARCHAR); CAST(NULL AS VARCHAR)"))
def extract_jms_publishers(spark, sf):
    return _publishers(spark, sf, "ACTIVEMQ")


VALIDATORS = """class Form@k@ {
  @NotNull @Size(min = 1) private String name@n@;
  @Unknown private String free;
}
class Check@k@ implements ConstraintValidator<Good, String> { public boolean isValid(String s, Context c) { return s != null; } }
"""


@query(expected("class_name annotation_type element_name is_built_in has_body", "'Form' || k; 'NotNull'; 'name' || n; true; false", "'Form' || k; 'Size'; 'name' || n; true; false", "'Check' || k; ''; 'isValid'; false; true"))
def extract_validators(spark, sf):
    return relation(spark, sf, VALIDATORS, "validator").select("class_name", "annotation_type", "element_name", "is_built_in", (F.trim("is_valid_body") != "").alias("has_body"))


# --- database ---------------------------------------------------------------------------------------

DATABASE = """import org.springframework.data.repository.CrudRepository;
@NamedQuery(name = "n", query = "select o from Order@k@ o")
@NamedNativeQueries({@NamedNativeQuery(name = "a", query = "select 1 from t@k@")})
class Db@k@ {
  EntityManager entityManager; Session session; Connection conn;
  void template() { jdbcTemplate.queryForList("SELECT * FROM stock@k@ WHERE n = ?", x); jdbcTemplate.getDataSource(); }
  void raw() { conn.prepareStatement("UPDATE bins@k@ SET n = 1"); statement.executeQuery("SELECT a FROM b@k@"); }
  void manager() { entityManager.persist(o); entityManager.createNativeQuery("select @k@"); entityManager.createQuery("from E@k@"); }
  void hibernate() { session.saveOrUpdate(o); session.createSQLQuery("select 2"); session.createQuery("from H@k@"); }
  @Procedure(name = "proc@k@") void stored() { }
  @Transactional public void unit(int a, int b) { }
}
@Transactional class Whole@k@ { public void open() { } void closed() { } }
interface Orders@k@ extends CrudRepository<Order@n@, Long> {
  Order findByName(String s);
  @Query("select o from Order o") List<Order> all();
  @Query(value = "select * from orders", nativeQuery = true) List<Order> rows(int x);
  void other();
}
"""


def _accesses(spark, sf, *kinds: str) -> DataFrame:
    return relation(spark, sf, DATABASE, "db_access").where(F.col("type").isin(*kinds)).select("type", "class_name", "method_name", "sql", "table_hint", "entity_type", "procedure_name")


_ACCESS = "type class_name method_name sql table_hint entity_type procedure_name"


@query(expected(_ACCESS, "'JDBC_TEMPLATE'; 'Db' || k; 'template'; 'SELECT * FROM stock' || k || ' WHERE n = ?'; 'stock' || k; ''; ''"))
def extract_jdbc_template(spark, sf):
    return _accesses(spark, sf, "JDBC_TEMPLATE")


@query(expected(_ACCESS, "'RAW_JDBC'; 'Db' || k; 'raw'; 'UPDATE bins' || k || ' SET n = 1'; 'bins' || k; ''; ''", "'RAW_JDBC'; 'Db' || k; 'raw'; 'SELECT a FROM b' || k; 'b' || k; ''; ''"))
def extract_raw_jdbc(spark, sf):
    return _accesses(spark, sf, "RAW_JDBC")


@query(expected(_ACCESS, "'ENTITY_MANAGER'; 'Db' || k; 'manager'; ''; ''; ''; ''", "'NATIVE_SQL'; 'Db' || k; 'manager'; 'select ' || k; ''; ''; ''", "'JPQL_HQL'; 'Db' || k; 'manager'; 'from E' || k; ''; ''; ''"))
def extract_entity_manager(spark, sf):
    return _accesses(spark, sf, "ENTITY_MANAGER", "NATIVE_SQL", "JPQL_HQL").where("method_name = 'manager'")


@query(expected(_ACCESS, "'HIBERNATE_SESSION'; 'Db' || k; 'hibernate'; ''; ''; ''; ''", "'NATIVE_SQL'; 'Db' || k; 'hibernate'; 'select 2'; ''; ''; ''", "'JPQL_HQL'; 'Db' || k; 'hibernate'; 'from H' || k; ''; ''; ''"))
def extract_hibernate_session(spark, sf):
    return _accesses(spark, sf, "HIBERNATE_SESSION", "NATIVE_SQL", "JPQL_HQL").where("method_name = 'hibernate'")


@query(expected(_ACCESS, "'SPRING_DATA'; 'Orders' || k; 'findByName'; ''; ''; 'Order' || n; ''", "'JPQL_HQL'; 'Orders' || k; 'all'; 'select o from Order o'; ''; 'Order' || n; ''", "'NATIVE_SQL'; 'Orders' || k; 'rows'; 'select * from orders'; ''; 'Order' || n; ''"))
def extract_spring_data(spark, sf):
    return _accesses(spark, sf, "SPRING_DATA", "NATIVE_SQL", "JPQL_HQL").where("class_name LIKE 'Orders%'")


@query(expected(_ACCESS, "'JPQL_HQL'; 'Db' || k; ''; 'select o from Order' || k || ' o'; ''; ''; ''", "'NATIVE_SQL'; 'Db' || k; ''; 'select 1 from t' || k; ''; ''; ''"))
def extract_named_queries(spark, sf):
    return _accesses(spark, sf, "NATIVE_SQL", "JPQL_HQL").where("method_name = ''")


@query(expected(_ACCESS, "'STORED_PROCEDURE'; 'Db' || k; 'stored'; ''; ''; ''; 'proc' || k"))
def extract_stored_procedures(spark, sf):
    return _accesses(spark, sf, "STORED_PROCEDURE")


@query(expected("class_name method_name is_transaction_root param_count", "'Db' || k; 'unit'; true; 2", "'Whole' || k; 'open'; true; 0"))
def extract_transactions(spark, sf):
    return relation(spark, sf, DATABASE, "db_access").where("type = 'TRANSACTION'").select("class_name", "method_name", "is_transaction_root", "param_count")


@query("SELECT finding_type, n * (SELECT count(*) FROM supplier) AS n FROM (VALUES ('SPRING_DATA_INTERFACE', 1), ('DATABASE_PROCEDURE_CALL', 1), ('NATIVE_SQL_QUERY', 4), ('JPQL_HQL_QUERY', 4), ('CONSTRAINT_VALIDATOR', 1)) t(finding_type, n)")
def extract_granular_types(spark, sf):
    from corpusloom.operators import planner

    facts = run.extract(sources(spark, sf, DATABASE + VALIDATORS))
    found = planner.reclassified(run.relation(facts, "db_access"), run.relation(facts, "validator"))
    return found.groupBy("finding_type").agg(F.count("*").alias("n"))


# --- outgoing calls, call sites -----------------------------------------------------------------------

HTTP = """class Http@k@ {
  void rest() { restTemplate.getForObject("/stock/@k@", String.class); restTemplate.exchange("/x@k@", HttpMethod.PUT, e, X.class); }
  void web() { webClient.post().uri("/w@k@").retrieve(); }
  void client() { restClient.get().uri("/c/${v}").retrieve(); }
  void java() { httpClient.send(HttpRequest.newBuilder(URI.create("http://j@k@")).build(), h); }
  void connection() { HttpURLConnection c = new URL("http://u@k@/x").openConnection(); c.setRequestMethod("DELETE"); }
  void apache() { new HttpGet("/apache@k@"); }
  void ok() { OkHttpClient k; k.newCall(new Request.Builder().url("/ok@k@").post(b).build()); }
}
@FeignClient(name = "f", path = "/base@n@") interface Feign@k@ { @GetMapping("/f@k@") String f(); }
@HttpExchange("/e@n@") interface Exchange@k@ { @PostExchange("/p@k@") void p(); }
"""
_CLIENTS = {
    "rest_template": ("REST_TEMPLATE", "'GET'; '/stock/' || k; false; 'rest'", "'PUT'; '/x' || k; false; 'rest'"),
    "web_client": ("WEB_CLIENT", "'POST'; '/w' || k; false; 'web'"),
    "rest_client": ("REST_CLIENT", "'GET'; '/c/${v}'; true; 'client'"),
    "java_http_client": ("JAVA_NET_HTTP_CLIENT", "'GET'; 'http://j' || k; false; 'java'"),
    "url_connection": ("HTTP_URL_CONNECTION", "'DELETE'; 'http://u' || k || '/x'; false; 'connection'"),
    "apache_client": ("APACHE_HTTP_CLIENT", "'GET'; '/apache' || k; false; 'apache'"),
    "ok_http": ("OK_HTTP", "'POST'; '/ok' || k; false; 'ok'"),
    "feign": ("FEIGN", "'GET'; '/base' || n || '/f' || k; false; 'f'"),
    "http_exchange": ("HTTP_EXCHANGE", "'POST'; '/e' || n || '/p' || k; false; 'p'"),
}


def _client_query(name: str, kind: str, *rows: str) -> None:
    def found(spark, sf):
        return relation(spark, sf, HTTP, "http_call").where(F.col("client_type") == kind).select("method", "url_pattern", "is_expression", "encapsulated_in")

    found.__name__ = f"extract_{name}"
    query(expected("method url_pattern is_expression encapsulated_in", *rows))(found)


for _name, (_kind, *_rows) in _CLIENTS.items():
    _client_query(_name, _kind, *_rows)

CALLS = """import java.util.regex.*;
import org.slf4j.Logger;
class Calls@k@ {
  private Store@n@ store; private Logger log; private List<String> names; private Pattern own;
  void go(Audit@k@ audit) { store.load(1, 2); audit.mark(); this.help(); help(3); log.info("x"); names.add("y"); unknown.run(); }
  void help() { }
}
"""


@query(expected("source_method target_type method_name arg_count", "'go'; 'Store' || n; 'load'; 2", "'go'; 'Audit' || k; 'mark'; 0", "'go'; 'Calls' || k; 'help'; 0", "'go'; 'Calls' || k; 'help'; 1"))
def extract_call_sites(spark, sf):
    return relation(spark, sf, CALLS, "call_site").select("source_method", "target_type", "method_name", "arg_count")


# --- templates and XML ----------------------------------------------------------------------------------

JSP = """<FORM action="/save/@k@" method="post"><input name="a@n@"><select name='x'></select><input name="a@n@"></FORM>
<form action="${dyn}"></form><a href="/show/@k@">s</a><a href="http://out">o</a><a href="#here">h</a>"""
THYMELEAF = """<form th:action="@{/update/@k@}" th:method="put"><input th:field="*{name@n@}"/><input name="plain"/></form>
<a th:href="@{/list/@k@}">l</a><a th:href="${x}">n</a>"""
_FORM = "http_method url_pattern is_expression fields link_type"


def _forms(spark, sf, template: str, path: str) -> DataFrame:
    return markup.apply(sources(spark, sf, template, path), markup.forms, markup.FORM_SCHEMA).select("http_method", "url_pattern", "is_expression", joined(F.col("field_names")).alias("fields"), "link_type")


@query(expected(_FORM, "'POST'; '/save/' || k; false; 'a' || n; 'FORM'", "'GET'; '${dyn}'; true; ''; 'FORM'", "'GET'; '/show/' || k; false; ''; 'LINK'"))
def extract_jsp_forms(spark, sf):
    return _forms(spark, sf, JSP, "web/@k@.jsp")


@query(expected(_FORM, "'PUT'; '/update/' || k; false; 'name' || n || '|plain'; 'FORM'", "'GET'; '/list/' || k; false; ''; 'LINK'"))
def extract_thymeleaf_forms(spark, sf):
    return _forms(spark, sf, THYMELEAF, "templates/@k@.html")


@query(expected(_FORM, "'GET'; '/list/' || k; false; ''; 'LINK'"))
def extract_fragment_links(spark, sf):
    return _forms(spark, sf, THYMELEAF, "templates/fragments/@k@.html")


BEANS = """<beans xmlns="http://www.springframework.org/schema/beans" xmlns:util="http://www.springframework.org/schema/util" xmlns:context="http://www.springframework.org/schema/context">
  <bean id="one@k@" class="shop.One"/><alias name="one@k@" alias="uno"/><import resource="b@n@.xml"/>
  <context:component-scan base-package="shop.n@n@"/><util:list id="all"/>
</beans>"""


@query(expected("type bean_id bean_class reference", "'bean'; 'one' || k; 'shop.One'; CAST(NULL AS VARCHAR)", "'alias'; 'uno'; NULL; 'one' || k", "'import'; NULL; NULL; 'b' || n || '.xml'", "'component_scan'; NULL; NULL; 'shop.n' || n", "'namespace'; 'all'; 'java.util.List'; NULL"))
def extract_xml_beans(spark, sf):
    return markup.apply(sources(spark, sf, BEANS, "conf/@k@.xml"), markup.beans, markup.BEAN_SCHEMA).select("type", "bean_id", "bean_class", "reference")


IMPORTING = """<beans><import resource="classpath:f@n@.xml"/></beans>"""


@query("""
WITH RECURSIVE hop AS (SELECT DISTINCT 'conf/f' || s_suppkey || '.xml' AS f, 'conf/f' || s_nationkey || '.xml' AS t FROM supplier),
walk AS (SELECT f, t FROM hop UNION SELECT w.f, h.t FROM walk w JOIN hop h ON w.t = h.f)
SELECT f AS source, t AS target FROM walk WHERE f <> t""")
def xml_import_closure(spark, sf):
    beans = markup.apply(sources(spark, sf, IMPORTING, "conf/f@k@.xml"), markup.beans, markup.BEAN_SCHEMA)
    return markup.import_closure(beans).select("source", "target")


# --- entry points -----------------------------------------------------------------------------------------

ENTRIES = ENDPOINTS + SCHEDULES + BROKERS + EVENTS


def _entries(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    facts = run.extract(sources(spark, sf, ENTRIES))
    return tuple(run.relation(facts, k) for k in ("endpoint", "scheduled_task", "broker_listener", "event_listener"))


@query(expected(
    "id ep_type topic_or_queue schedule",
    "'HTTP:GET:/n' || n || '/o' || k || '/{id}:Orders' || k || ':show'; 'HTTP'; CAST(NULL AS VARCHAR); CAST(NULL AS VARCHAR)",
    "'HTTP:POST:/n' || n || '/a' || k || ':Orders' || k || ':add'; 'HTTP'; NULL; NULL",
    "'HTTP:POST:/n' || n || '/b' || k || ':Orders' || k || ':add'; 'HTTP'; NULL; NULL",
    "'HTTP:PUT:/n' || n || '/r' || k || ':Orders' || k || ':put'; 'HTTP'; NULL; NULL",
    "'SCHEDULED:Jobs' || k || ':nightly'; 'SCHEDULED'; NULL; '0 ' || n || ' * * * *'",
    "'SCHEDULED:Jobs' || k || ':often'; 'SCHEDULED'; NULL; '5000'",
    "'SCHEDULED:Jobs' || k || ':later'; 'SCHEDULED'; NULL; k",
    "'SCHEDULED:Jobs' || k || ':odd'; 'SCHEDULED'; NULL; NULL",
    "'KAFKA:orders' || k || ',returns:Messages' || k || ':a'; 'KAFKA'; 'orders' || k || ',returns'; NULL",
    "'KAFKA:all.' || k || '.*:Messages' || k || ':b'; 'KAFKA'; 'all.' || k || '.*'; NULL",
    "'RABBITMQ:q' || k || ':Messages' || k || ':c'; 'RABBITMQ'; 'q' || k; NULL",
    "'ACTIVEMQ:d' || k || ':Messages' || k || ':d'; 'ACTIVEMQ'; 'd' || k; NULL",
    "'EVENT:Paid' || k || ':Events' || k || ':on'; 'EVENT'; NULL; NULL",
    "'EVENT:Closed' || k || ':Events' || k || ':closed'; 'EVENT'; NULL; NULL",
))
def entry_point_union(spark, sf):
    return flows.entry_points(*_entries(spark, sf)).select("id", "ep_type", "topic_or_queue", "schedule")


@query(expected("class_name method_name", *(f"'{c}' || k; '{m}'" for c, ms in (("Jobs", ("nightly", "often", "later", "odd")), ("Messages", "abcd"), ("Events", ("on", "closed"))) for m in ms)))
def known_method_union(spark, sf):
    return flows.known_methods(*_entries(spark, sf)[1:]).select("class_name", "method_name")


@query("SELECT kind, count(*) AS n FROM (SELECT unnest(['error', 'component']) AS kind FROM supplier) GROUP BY kind")
def extract_survives_broken_files(spark, sf):
    broken, good = sources(spark, sf, "class { ]@k@", "a/B@k@.java"), sources(spark, sf, "@Service class G@k@ {}", "a/G@k@.java")
    facts = run.extract(broken.unionByName(good))
    return facts.where("kind IN ('error', 'component')").groupBy("kind").agg(F.count("*").alias("n"))
