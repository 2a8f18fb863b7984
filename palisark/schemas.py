"""Row schemas. ``properties`` and ``metadata`` are VARIANT: their shape is the input's."""

RESOURCE = (
    "source_file string, ord int, resource_type string, address string, name string, provider string, properties variant, "
    "dependencies array<string>, module string, source_location string"
)
NODE = "source_file string, ord int, id string, resource_type string, name string, category string, trust_zone string, properties variant, provider string, module string"
EDGE = "source_file string, ord int, source string, target string, edge_type string, source_zone string, target_zone string, crosses_trust_boundary boolean"
THREAT_COLUMNS = (
    "source_file", "id", "title", "description", "stride_category", "severity", "source", "resource_type", "resource_address", "mitigation",
    "rule_id", "confidence", "metadata", "mitre_techniques", "mitre_tactics", "sev_rank",
)
SECRET = "id string, finding_type string, title string, severity string, file_path string, line_number int, secret_type string, match string, rule_id string"
VULNERABILITY = (
    "id string, ecosystem string, package string, version_introduced string, version_fixed string, severity string, cvss_score double, "
    "summary string, aliases string, references_json string"
)
OS_VULNERABILITY = "id string, os_family string, os_version string, package string, version_fixed string, severity string, cvss_score double, summary string"
DEPENDENCY = "source_file string, ord int, name string, version string, ecosystem string, license string"
OS_PACKAGE = "name string, version string, release string, epoch int, arch string, source_name string, source_version string, license string"
