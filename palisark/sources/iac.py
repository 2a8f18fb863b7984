"""Infrastructure as code to resource rows (``schemas.RESOURCE``)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisark import dims
from palisark.session import written
from palisark.sources import files

MAX_MODULE_DEPTH = 50
NO_DEPS = "array<string>"


def _get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _resource(source: Column, ord_: Column, kind: Column, address: Column, name: Column, provider: Column, props: Column, deps: Column | None = None, module: Column | None = None) -> list[Column]:
    none = F.array().cast(NO_DEPS)
    return [
        source.alias("source_file"), ord_.cast("int").alias("ord"), kind.alias("resource_type"), address.alias("address"), name.alias("name"),
        provider.alias("provider"), props.alias("properties"), F.coalesce(deps, none).alias("dependencies") if deps is not None else none.alias("dependencies"),
        (module if module is not None else F.lit("")).alias("module"), source.alias("source_location"),
    ]


def terraform_plan(docs: DataFrame) -> DataFrame:
    """Plan JSON: the resources of all planned modules, with what their configuration refers to.

    Modules nest; a recursive query walks them down to MAX_MODULE_DEPTH. Explicit dependencies take the module's
    address in front, references in expressions don't; references to variables don't count.
    """
    spark = docs.sparkSession
    docs.select("source_file", "doc").createOrReplaceTempView("palisark_plans")
    planned = spark.sql(f"""
        WITH RECURSIVE m(source_file, depth, at, address, module) AS (
            SELECT source_file, 0, array(0), '', try_variant_get(doc, '$.planned_values.root_module', 'variant') FROM palisark_plans
            UNION ALL
            SELECT source_file, depth + 1, array_append(at, pos), coalesce(try_variant_get(c, '$.address', 'string'), ''), c
            FROM (SELECT m.source_file, m.depth, m.at, posexplode(try_variant_get(m.module, '$.child_modules', 'array<variant>')) AS (pos, c) FROM m)
            WHERE depth < {MAX_MODULE_DEPTH})
        SELECT source_file, at, address AS module_address, posexplode(try_variant_get(module, '$.resources', 'array<variant>')) AS (pos, r) FROM m
    """)
    config = spark.sql(f"""
        WITH RECURSIVE m(source_file, depth, prefix, module) AS (
            SELECT source_file, 0, '', try_variant_get(doc, '$.configuration.root_module', 'variant') FROM palisark_plans
            UNION ALL
            SELECT source_file, depth + 1, concat(prefix, 'module.', k, '.'), try_variant_get(c, '$.module', 'variant')
            FROM (SELECT m.source_file, m.depth, m.prefix, explode(try_variant_get(m.module, '$.module_calls', 'map<string,variant>')) AS (k, c) FROM m)
            WHERE depth < {MAX_MODULE_DEPTH})
        SELECT source_file, prefix, explode(try_variant_get(module, '$.resources', 'array<variant>')) AS r FROM m
    """)
    explicit = F.transform(F.coalesce(_get("r", "$.depends_on", NO_DEPS), F.array().cast(NO_DEPS)), lambda d: F.concat("prefix", d))
    expressions = F.map_values(F.coalesce(_get("r", "$.expressions", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    refs = F.flatten(F.transform(expressions, lambda e: F.coalesce(F.try_variant_get(e, "$.references", NO_DEPS), F.array().cast(NO_DEPS))))
    known = F.filter(refs, lambda x: ~x.startswith("var."))
    address = F.concat("prefix", F.concat_ws(".", _get("r", "$.type"), _get("r", "$.name")))
    deps = config.select("source_file", address.alias("address"), F.array_union(explicit, known).alias("deps"))
    deps = deps.groupBy("source_file", "address").agg(F.array_distinct(F.flatten(F.collect_list("deps"))).alias("deps"))
    order = F.row_number().over(W.partitionBy("source_file").orderBy("at", "pos")) - 1
    rows = planned.select(
        "source_file", order.alias("ord"), _get("r", "$.type").alias("type"), _get("r", "$.address").alias("address"), _get("r", "$.name").alias("name"),
        _get("r", "$.provider_name").alias("provider"), _get("r", "$.values", "variant").alias("props"), "module_address",
    ).join(deps, ["source_file", "address"], "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    props = F.coalesce("props", F.parse_json(F.lit("{}")))
    return rows.select(*_resource(F.col("source_file"), F.col("ord"), text("type"), text("address"), text("name"), text("provider"), props, F.col("deps"), F.col("module_address")))


#: CloudFormation types that have a name of their own.
CLOUDFORMATION_TYPES = {
    "AWS::S3::Bucket": "aws_s3_bucket", "AWS::EC2::Instance": "aws_instance", "AWS::EC2::SecurityGroup": "aws_security_group", "AWS::EC2::VPC": "aws_vpc",
    "AWS::EC2::Subnet": "aws_subnet", "AWS::EC2::InternetGateway": "aws_internet_gateway", "AWS::RDS::DBInstance": "aws_db_instance",
    "AWS::Lambda::Function": "aws_lambda_function", "AWS::IAM::Role": "aws_iam_role", "AWS::IAM::Policy": "aws_iam_policy", "AWS::IAM::User": "aws_iam_user",
    "AWS::DynamoDB::Table": "aws_dynamodb_table", "AWS::SQS::Queue": "aws_sqs_queue", "AWS::SNS::Topic": "aws_sns_topic", "AWS::ECS::Service": "aws_ecs_service",
    "AWS::ECS::TaskDefinition": "aws_ecs_task_definition", "AWS::ElasticLoadBalancingV2::LoadBalancer": "aws_lb",
    "AWS::CloudFront::Distribution": "aws_cloudfront_distribution",
}


def snake_case(text: Column) -> Column:
    """An underscore before each capitalised word, and between a small letter or digit and a capital."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def cloudformation_type(kind: Column) -> Column:
    parts = F.split(kind, "::")
    general = F.concat_ws("_", F.lit("aws"), F.lower(F.get(parts, F.lit(1))), snake_case(F.get(parts, F.lit(2))))
    plain = F.replace(F.lower(kind), F.lit("::"), F.lit("_"))
    known = F.try_element_at(dims.literal_map(CLOUDFORMATION_TYPES), kind)
    return F.coalesce(known, F.when(kind.startswith("AWS::") & (F.size(parts) >= 3), general).otherwise(plain))


def cloudformation(docs: DataFrame) -> DataFrame:
    """Templates: a resource for each entry of Resources; DependsOn is a name or a list."""
    each = docs.select("source_file", F.explode(_get("doc", "$.Resources", "map<string,variant>")).alias("name", "r"))
    kind = F.coalesce(_get("r", "$.Type"), F.lit(""))
    one = _get("r", "$.DependsOn")
    many = _get("r", "$.DependsOn", NO_DEPS)
    deps = F.coalesce(many, F.when(one.isNotNull(), F.array(one)))
    order = F.row_number().over(W.partitionBy("source_file").orderBy("name")) - 1
    props = F.coalesce(_get("r", "$.Properties", "variant"), F.parse_json(F.lit("{}")))
    rows = each.withColumn("ord", order)
    return rows.select(*_resource(F.col("source_file"), F.col("ord"), cloudformation_type(kind), F.col("name"), F.col("name"), F.lit("aws"), props, deps))


#: Kubernetes kinds by resource type, workloads, capabilities that are dangerous.
KUBERNETES_TYPES = {
    "Deployment": "deployment", "DaemonSet": "daemon_set", "StatefulSet": "stateful_set", "ReplicaSet": "replica_set", "Job": "job", "CronJob": "cron_job", "Pod": "pod",
    "Service": "service", "Ingress": "ingress", "ConfigMap": "config_map", "Secret": "secret", "NetworkPolicy": "network_policy", "ServiceAccount": "service_account",
    "Role": "role", "ClusterRole": "cluster_role", "RoleBinding": "role_binding", "ClusterRoleBinding": "cluster_role_binding", "Namespace": "namespace",
    "PersistentVolumeClaim": "pvc",
}
WORKLOADS = ("Deployment", "DaemonSet", "StatefulSet", "ReplicaSet", "Job", "CronJob", "Pod")
DANGEROUS = ("NET_ADMIN", "SYS_ADMIN", "SYS_PTRACE", "NET_RAW", "SYS_MODULE", "DAC_OVERRIDE")
VARIANTS = "array<variant>"


def kubernetes(docs: DataFrame) -> DataFrame:
    """Manifests: one resource a document; workloads have flags folded over their containers and init containers.

    Two of the flags, privilege escalation and a writable root, are those of the last container.
    """
    d = docs.where(_get("doc", "$.kind").isNotNull()).withColumn("kind", _get("doc", "$.kind"))
    kind = F.col("kind")
    pod = (
        F.when(kind == "Pod", _get("doc", "$.spec", "variant")).when(kind == "CronJob", _get("doc", "$.spec.jobTemplate.spec.template.spec", "variant"))
        .otherwise(_get("doc", "$.spec.template.spec", "variant"))
    )
    d = d.withColumn("pod", F.when(kind.isin(*WORKLOADS), pod))
    none = F.array().cast(VARIANTS)
    containers = F.concat(F.coalesce(_get("pod", "$.containers", VARIANTS), none), F.coalesce(_get("pod", "$.initContainers", VARIANTS), none))
    some = F.col("pod").isNotNull() & ~F.to_json("pod").isin("{}", "null")
    d = d.withColumn("containers", F.when(some, containers))
    c = F.col("containers")
    flag = lambda x, p, default=False: F.coalesce(_get(x, p, "boolean"), F.lit(default))
    any_of = lambda f: F.exists(c, f)
    all_of = lambda f: F.forall(c, f)
    full = lambda x, p: F.coalesce(~F.to_json(_get(x, p, "variant")).isin("{}", "null", "[]", '""'), F.lit(False))
    image = lambda x: F.coalesce(_get(x, "$.image"), F.lit(""))
    names = lambda x, p: F.coalesce(_get(x, p, NO_DEPS), F.array().cast(NO_DEPS))
    last = F.try_element_at(c, F.lit(-1))
    secret_env = F.flatten(
        F.transform(c, lambda x: F.transform(F.filter(F.coalesce(_get(x, "$.env", VARIANTS), none), lambda e: _get(e, "$.valueFrom.secretKeyRef", "variant").isNotNull()), lambda e: _get(e, "$.name")))
    )
    workload = {
        "privileged": any_of(lambda x: flag(x, "$.securityContext.privileged")),
        "run_as_root": ~any_of(lambda x: flag(x, "$.securityContext.runAsNonRoot")),
        "has_resource_limits": all_of(lambda x: full(x, "$.resources.limits")),
        "has_security_context": all_of(lambda x: full(x, "$.securityContext")),
        "writable_root_fs": ~flag(last, "$.securityContext.readOnlyRootFilesystem"),  # without containers: true, like the next
        "allow_privilege_escalation": flag(last, "$.securityContext.allowPrivilegeEscalation", True),
        "capabilities_dropped": any_of(lambda x: F.arrays_overlap(names(x, "$.securityContext.capabilities.drop"), F.array(F.lit("ALL"), F.lit("all")))),
        "dangerous_capabilities": F.flatten(F.transform(c, lambda x: F.filter(names(x, "$.securityContext.capabilities.add"), lambda n: n.isin(*DANGEROUS)))),
        "uses_latest_tag": any_of(lambda x: ~image(x).contains(":") | image(x).endswith(":latest")),
        "has_liveness_probe": all_of(lambda x: full(x, "$.livenessProbe")),
        "has_readiness_probe": all_of(lambda x: full(x, "$.readinessProbe")),
        "has_host_port": any_of(lambda x: F.exists(F.coalesce(_get(x, "$.ports", VARIANTS), none), lambda p: F.coalesce(_get(p, "$.hostPort", "int") != 0, F.lit(False)))),
        "secret_env_vars": secret_env,
        "host_network": flag("pod", "$.hostNetwork"), "host_pid": flag("pod", "$.hostPID"), "host_ipc": flag("pod", "$.hostIPC"),
        "service_account_name": F.coalesce(_get("pod", "$.serviceAccountName"), F.lit("default")),
        "automount_sa_token": flag("pod", "$.automountServiceAccountToken", True),
        "has_host_path_volume": F.exists(F.coalesce(_get("pod", "$.volumes", VARIANTS), none), lambda v: _get(v, "$.hostPath", "variant").isNotNull()),
        "pod_run_as_non_root": _get("pod", "$.securityContext.runAsNonRoot", "boolean"), "pod_run_as_user": _get("pod", "$.securityContext.runAsUser", "long"),
    }
    rules = F.coalesce(_get("doc", "$.rules", VARIANTS), _get("doc", "$.spec.rules", VARIANTS), none)
    role = {
        "rbac_rules": rules, "has_wildcard_verbs": F.exists(rules, lambda r: F.array_contains(names(r, "$.verbs"), "*")),
        "has_wildcard_resources": F.exists(rules, lambda r: F.array_contains(names(r, "$.resources"), "*")),
    }
    binding = {
        "role_ref_name": F.coalesce(_get("doc", "$.roleRef.name"), F.lit("")), "role_ref_kind": F.coalesce(_get("doc", "$.roleRef.kind"), F.lit("")),
        "subjects": F.coalesce(_get("doc", "$.subjects", VARIANTS), none),
    }
    service = {"service_type": F.coalesce(_get("doc", "$.spec.type"), F.lit("ClusterIP")), "ports": F.coalesce(_get("doc", "$.spec.ports", VARIANTS), none)}
    policy = {
        "has_ingress_rules": full("doc", "$.spec.ingress"), "has_egress_rules": full("doc", "$.spec.egress"), "policy_types": names("doc", "$.spec.policyTypes"),
    }
    name = F.coalesce(_get("doc", "$.metadata.name"), F.lit(""))
    space = F.coalesce(_get("doc", "$.metadata.namespace"), F.lit("default"))
    base = {
        "kind": kind, "apiVersion": _get("doc", "$.apiVersion"), "name": name, "namespace": space, "labels": _get("doc", "$.metadata.labels", "variant"),
        "annotations": _get("doc", "$.metadata.annotations", "variant"),
    }
    packed = lambda *parts: F.to_variant_object(F.struct(*[v.alias(k) for p in parts for k, v in p.items()]))
    props = (
        F.when(F.col("containers").isNotNull(), packed(base, workload)).when(kind.isin("Role", "ClusterRole"), packed(base, role))
        .when(kind.isin("RoleBinding", "ClusterRoleBinding"), packed(base, binding)).when(kind == "Service", packed(base, service))
        .when(kind == "NetworkPolicy", packed(base, policy)).otherwise(packed(base))
    )
    known = F.coalesce(F.try_element_at(dims.literal_map(KUBERNETES_TYPES), kind), F.lower(kind))
    rtype = F.concat(F.lit("kubernetes_"), known)
    return d.select(*_resource(F.col("source_file"), F.col("doc_no"), rtype, F.concat_ws(".", rtype, space, name), name, F.lit("kubernetes"), props))


#: What of a chart's template language goes, in order; the documents that are left are read as manifests.
TEMPLATE_PATTERNS = ((r"\{\{-?\s*/\*[\s\S]*?\*/\s*-?\}\}", ""), (r"(?m)^\s*\{\{-?[\s\S]*?-?\}\}\s*$", ""), (r"\{\{-?[\s\S]*?-?\}\}", "placeholder"))


def helm(rows: DataFrame) -> DataFrame:
    """Charts: the templates of each (source_file, text), without the template language, as manifests of the chart."""
    text = reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), TEMPLATE_PATTERNS, F.col("text"))
    chart = F.regexp_replace("source_file", "/?templates/[^/]*$", "")
    parts = rows.where(F.col("source_file").rlike(r"(^|/)templates/[^/]*\.ya?ml$")).select(chart.alias("chart"), "source_file", text.alias("text"))
    joined = parts.groupBy("chart").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_file", "text"))), lambda x: x["text"]), "\n---\n").alias("text"))
    return kubernetes(files.documents(joined.select(F.concat("chart", F.lit("/Chart.yaml")).alias("source_file"), "text")))


SECRET_KEY = r"(?i)(password|secret|key|token|api_key|apikey|auth|credential)"
SENSITIVE_FILE = r"\.(key|pem|p12|pfx)$|id_rsa|\.env$"


def dockerfile(rows: DataFrame) -> DataFrame:
    """Dockerfiles: a resource for each instruction, and one summary of the file.

    Each row of (source_file, text) is a file of its own. Its instructions and its summary are made in the task that
    reads it, in one pass and without a shuffle; a file without instructions has no resource.
    """
    pattern = r"^([A-Z]+)\s+(.+)$"
    lines = F.transform(F.split(F.regexp_replace("text", r"\\\s*\n", " "), r"\r\n|\n|\r"), lambda x, at: F.struct(at.alias("at"), F.trim(x).alias("line")))
    lines = F.filter(lines, lambda x: x["line"].rlike(pattern) & ~x["line"].startswith("#"))
    part = lambda x, n: F.regexp_extract(x["line"], pattern, n)
    parsed = rows.select("source_file", F.transform(lines, lambda x: F.struct(x["at"].alias("at"), part(x, 1).alias("op"), part(x, 2).alias("args"))).alias("found"))
    parsed = parsed.where(F.size("found") > 0)

    words_of = lambda args: F.filter(F.split(args, r"\s+"), lambda x: x != "")
    image_of = lambda args: F.coalesce(F.get(words_of(args), F.lit(0)), F.lit(""))
    tag_of = lambda image: F.when(image.contains(":") & ~image.startswith("sha256:"), F.substring_index(image, ":", -1)).when(~image.contains("@"), "latest").otherwise("")
    ports_of = lambda args: F.filter(F.transform(words_of(args), lambda w: F.substring_index(w, "/", 1).try_cast("int")), lambda p: p.isNotNull())
    chown_of = lambda args: args.contains("--chown") | args.contains("--chmod")

    args_of = lambda name: F.transform(F.filter("found", lambda x: x["op"] == name), lambda x: x["args"])
    count = lambda a: F.size(a).cast("long")
    own = {"froms": args_of("FROM"), "users": args_of("USER"), "exposes": args_of("EXPOSE"), "copies": args_of("COPY"), "checks": args_of("HEALTHCHECK")}
    summary = parsed.withColumns(own).withColumns({
        "images": F.transform("froms", image_of), "exposed_ports": F.flatten(F.transform("exposes", ports_of)),
        "user_value": F.coalesce(F.trim(F.try_element_at("users", F.lit(-1))), F.lit("")),
    }).withColumn("facts", F.struct(
        (F.size("users") > 0).alias("has_user"), F.exists("checks", lambda a: F.upper(F.trim(a)) != "NONE").alias("has_healthcheck"),
        F.exists("images", lambda x: tag_of(x) == "latest").alias("uses_latest_tag"), "exposed_ports", F.coalesce(F.get("images", F.lit(0)), F.lit("")).alias("base_image"), "user_value",
        F.exists("found", lambda x: x["op"] == "WORKDIR").alias("has_workdir"), count(args_of("ENTRYPOINT")).alias("entrypoint_count"),
        F.array_contains("exposed_ports", 22).alias("has_ssh_exposed"), F.exists("exposed_ports", lambda p: p < 1024).alias("has_privileged_port"), count(args_of("ADD")).alias("add_count"),
        count(F.filter("copies", lambda a: ~chown_of(a))).alias("copy_without_chown"), F.lower("user_value").isin("root", "0").alias("is_root_user"),
    ))
    # The summary comes behind the instructions, as the one entry that has facts.
    fields = lambda x, facts: F.struct(x["at"].alias("at"), x["op"].alias("op"), x["args"].alias("args"), facts.alias("facts"))
    kind = summary.schema["facts"].dataType
    last = F.array(F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("string").alias("args"), F.col("facts").alias("facts")))
    entries = F.concat(F.transform("found", lambda x: fields(x, F.lit(None).cast(kind))), last)
    i = summary.select("source_file", F.posexplode(entries).alias("idx", "e")).select("source_file", "idx", "e.*")

    op, args = F.col("op"), F.col("args")
    words, image = words_of(args), image_of(args)
    port = F.try_element_at(ports_of(args), F.lit(-1))
    key = F.coalesce(F.get(F.split(F.trim(F.substring_index(args, "=", 1)), r"\s+"), F.lit(0)), F.lit(""))
    plain = F.filter(words, lambda w: ~w.startswith("--"))
    sources = F.slice(plain, F.lit(1), F.greatest(F.size(plain) - 1, F.lit(0)))
    base = {"instruction": op, "arguments": args, "line_number": F.col("at") + 1}
    packed = lambda **more: F.to_variant_object(F.struct(*[v.alias(k) for k, v in (base | more).items()]))
    run = {
        "has_sudo": args.contains("sudo ") | args.startswith("sudo"), "has_curl_pipe": args.rlike(r"(curl|wget)\s+.*\|\s*(sh|bash|zsh)"),
        "has_apt_no_recommends": args.contains("apt-get") & args.contains("install") & ~args.contains("--no-install-recommends"),
    }
    # A property that an instruction hasn't isn't there, rather than null.
    props = (
        F.when(F.col("facts").isNotNull(), F.to_variant_object("facts")).when(op == "FROM", packed(image=image, tag=tag_of(image))).when(op == "USER", packed(user=F.trim(args)))
        .when((op == "EXPOSE") & port.isNotNull(), packed(port=port)).when(op.isin("ENV", "ARG"), packed(key=key, has_secret_pattern=key.rlike(SECRET_KEY))).when(op == "RUN", packed(**run))
        .when((op == "ADD") & (F.size(words) >= 2), packed(is_local_add=~image.rlike("^https?://"), has_sensitive_file=image.rlike(SENSITIVE_FILE)))
        .when((op == "COPY") & F.exists(sources, lambda s: s.rlike(SENSITIVE_FILE)), packed(has_sensitive_file=F.lit(True), has_chown=chown_of(args)))
        .when(op == "COPY", packed(has_chown=chown_of(args))).otherwise(packed())
    )
    first = F.col("facts.base_image")
    whole = lambda a, b: F.when(F.col("facts").isNotNull(), a).otherwise(b)
    name = whole(F.concat(F.lit("Dockerfile ("), F.when(first == "", "unknown").otherwise(first), F.lit(")")), F.concat(op, F.lit(" "), F.substring(args, 1, 50)))
    address = whole(F.lit("dockerfile.image.summary"), F.concat(F.lit("dockerfile."), F.lower(op), F.lit("."), F.col("idx")))
    rtype = whole(F.lit("dockerfile_image"), F.concat(F.lit("dockerfile_"), F.lower(op)))
    return i.select(*_resource(F.col("source_file"), F.col("idx"), rtype, address, name, F.lit("docker"), props))


_TOKEN = re.compile(r'\s+|#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/|(<<-?(\w+)\n[\s\S]*?\n\s*\2\b)|("(?:\\.|\$\{[^}]*\}|[^"\\])*")|([{}\[\]=,:()])|([^\s{}\[\]=,:()"#]+)')


def hcl_blocks(text: str) -> Iterator[tuple[list[str], dict]]:
    """The top-level blocks of HCL: their words and their body. Expressions that aren't literals stay text."""
    tokens = [m.group(1) or m.group(3) or m.group(4) or m.group(5) for m in _TOKEN.finditer(text) if m.group(1) or m.group(3) or m.group(4) or m.group(5)]
    at = 0

    def literal(t: str) -> object:
        if t.startswith('"'):
            return t[1:-1].replace('\\"', '"')
        if t.startswith("<<"):
            return "\n".join(t.split("\n")[1:-1])
        named = {"true": True, "false": False, "null": None}
        if t in named:
            return named[t]
        return float(t) if re.fullmatch(r"-?\d+\.\d+", t) else int(t) if re.fullmatch(r"-?\d+", t) else "${" + t + "}"

    def value() -> object:
        nonlocal at
        t = tokens[at]
        at += 1
        if t == "[":
            out = []
            while at < len(tokens) and tokens[at] != "]":
                out.append(value())
                at += at < len(tokens) and tokens[at] == ","
            at += 1
            return out
        if t == "{":
            return body()
        if at < len(tokens) and tokens[at] == "(":  # a call stays text
            depth, parts = 0, [t]
            while at < len(tokens):
                parts.append(tokens[at])
                depth += {"(": 1, ")": -1}.get(tokens[at], 0)
                at += 1
                if not depth:
                    break
            return "${" + "".join(parts) + "}"
        return literal(t)

    def body() -> dict:
        nonlocal at
        out: dict = {}
        while at < len(tokens) and tokens[at] != "}":
            words = []
            while at < len(tokens) and tokens[at] not in "{}=:,":
                words.append(tokens[at].strip('"'))
                at += 1
            if at < len(tokens) and tokens[at] in "=:":
                at += 1
                out[" ".join(words)] = value() if at < len(tokens) else None
            elif at < len(tokens) and tokens[at] == "{":
                at += 1
                inner = body()
                for w in reversed(words[1:]):
                    inner = {w: inner}
                out.setdefault(words[0] if words else "", []).append(inner)
            else:
                at += 1
        at += 1
        return out

    while at < len(tokens):
        words = []
        while at < len(tokens) and tokens[at] != "{":
            words.append(tokens[at].strip('"'))
            at += 1
        at += 1
        if words:
            yield words, body()


def terraform_hcl(rows: DataFrame) -> DataFrame:
    """HCL files: a resource for each resource block, without dependencies; ``error`` where a file can't be read."""
    import json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for f, t in zip(x["source_file"], x["text"]):
                try:
                    found = [(w[1], w[2], b) for w, b in hcl_blocks(t or "") if len(w) == 3 and w[0] == "resource"]
                    out += [(f, i, kind, name, json.dumps(b), None) for i, (kind, name, b) in enumerate(found)]
                except (ValueError, IndexError, RecursionError) as e:
                    out.append((f, None, "", "", "{}", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["source_file", "ord", "kind", "name", "json", "error"]).astype({"ord": "Int32"})

    found = rows.select("source_file", "text").mapInPandas(run, "source_file string, ord int, kind string, name string, json string, error string")
    first = F.substring_index("kind", "_", 1)
    provider = F.when(first.isin("aws", "azurerm", "google"), F.concat(F.lit("hashicorp/"), first)).otherwise(first)
    return found.select(*_resource(F.col("source_file"), F.col("ord"), F.col("kind"), F.concat_ws(".", "kind", "name"), F.col("name"), provider, F.parse_json("json")), "error")


files.register_format("terraform_plan", files.is_plan, terraform_plan, 10)
files.register_format("cloudformation", files.is_cloudformation, cloudformation, 20)
files.register_format("kubernetes", files.is_kubernetes, kubernetes, 22)
files.register_format("dockerfile", files.is_dockerfile, dockerfile, 25, structured=False)
files.register_format("terraform_hcl", lambda p: p.endswith(".tf"), terraform_hcl, 30, structured=False)


@dataclass(frozen=True)
class Reading:
    """What ``read`` gives: resources (``schemas.RESOURCE``), files (source_file, format_type) that were read, and quarantine
    (``files.QUARANTINE``): files that nobody could read, with each parser that tried and its error."""

    resources: DataFrame
    files: DataFrame
    quarantine: DataFrame


def read(found: DataFrame) -> Reading:
    """The resources of the infrastructure files of ``files.walk``, and an account of all of them.

    Texts are parsed once. Each document is read as the first format, by priority, that fits it; a file that a format
    turns out unable to read is read by the next one that fits. Charts are read as such, and their templates with them.
    """
    rows = written(files.texts(found), "texts")
    path = F.col("source_file")
    infra = files.is_iac_candidate(path) & ~files.is_lockfile(path) & ~path.rlike(r"(^|/)templates/")
    plain = rows.withColumn("claims", files.claims(False)).where(infra | (F.size("claims") > 0))
    parsed = written(files.parsed(rows.where(infra & path.rlike(r"(?i)\.(json|ya?ml)$"))), "parsed")
    docs = parsed.where("error is null").drop("error").withColumn("claims", files.claims(True))
    order = F.array(*[F.lit(f.name) for f in sorted(files.FORMATS.values(), key=lambda f: f.priority)])
    both = plain.select("source_file", F.explode_outer("claims").alias("c")).unionByName(docs.select("source_file", F.explode("claims").alias("c")))
    listed = written(both.groupBy("source_file").agg(F.array_intersect(order, F.collect_set("c")).alias("formats")), "listed-files")
    failures = written(parsed.where("error is not null").select("source_file", F.lit("text").alias("parser"), "error"), "unparsed")
    good: list[DataFrame] = []
    todo = listed.where(F.size("formats") > 0).withColumn("failed", F.array().cast("array<string>"))
    while True:
        left = lambda c: F.get(F.array_except(c, F.col("failed")), F.lit(0))
        chosen = todo.select("source_file", "failed", left(F.col("formats")).alias("format_type")).where("format_type is not null")
        docs_now = docs.join(chosen.drop("format_type"), "source_file").withColumn("format_type", left(F.col("claims"))).drop("claims", "failed")
        plain_now = plain.drop("claims").join(chosen.drop("failed"), "source_file")
        out, errors = [], []
        for f in files.FORMATS.values():
            part = f.parse((docs_now if f.structured else plain_now).where(F.col("format_type") == f.name))
            if "error" in part.columns:
                part = written(part, "attempt")
                errors.append(part.where("error is not null").select("source_file", F.lit(f.name).alias("parser"), "error").distinct())
                part = part.where("error is null").drop("error")
            out.append(part)
        now = written(reduce(DataFrame.unionByName, errors), "failures") if errors else None
        again = now is not None and not now.isEmpty()
        made = reduce(DataFrame.unionByName, out)
        good.append(made.join(now.select("source_file").distinct(), "source_file", "left_anti") if again else made)
        if not again:
            break
        failures = failures.unionByName(now)
        tried = now.groupBy("source_file").agg(F.collect_set("parser").alias("now"))
        todo = written(todo.join(tried, "source_file").withColumn("failed", F.array_union("failed", "now")).drop("now"), "again")
    tried = failures.where("parser <> 'text'").groupBy("source_file").agg(F.collect_set("parser").alias("failed"))
    told = listed.join(tried, "source_file", "left").withColumn("failed", F.coalesce("failed", F.array().cast("array<string>")))
    told = written(told.select("source_file", left(F.col("formats")).alias("format_type")), "told")
    chart = files.file_name(path) == "Chart.yaml"
    unread = told.where(F.col("format_type").isNull() & ~chart).select("source_file")
    why = unread.join(failures, "source_file", "left")
    quarantine = why.select("source_file", F.coalesce("parser", F.lit("")).alias("parser"), F.coalesce("error", F.lit("no format fits")).alias("error"))
    read_files = told.select("source_file", F.coalesce("format_type", F.when(chart, "helm")).alias("format_type")).where("format_type is not null")
    return Reading(reduce(DataFrame.unionByName, [*good, helm(rows)]), read_files, quarantine)


def resources(found: DataFrame) -> DataFrame:
    """The resources of all infrastructure files of ``files.walk`` (see ``read``)."""
    return read(found).resources
