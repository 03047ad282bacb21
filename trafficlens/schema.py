"""The event log: one wide nullable schema for all kinds of event."""

from __future__ import annotations

KINDS = ("request", "policy_read", "trap_hit", "identity", "hunt", "credential", "tls", "sensor")

INDICATORS = "struct<wallets map<string,array<string>>, pools array<string>, urls array<string>, miners array<string>, downloaders array<string>, jndi variant, jndi_obfuscated boolean, shellshock boolean, metadata_ssrf boolean, decoded_layers int, url_decoded_layers int>"
ATTACK = "struct<cls string, location string, evidence string, decoded boolean, sig string, cve string>"

FIELDS = f"""
kind string, ts string, sensor string, build string, rid string, face string, actor string, actor_basis string,
ip string, method string, path string, query string, raw_path string, raw_query string, headers array<array<string>>,
headers_truncated boolean, host string, http_version string, ua string, status int, bytes bigint, duration_us bigint,
header_order array<string>, header_order_hash string, header_count int, claimed_crawler string, operator string,
claims_browser boolean, browser_header_score int, conditional boolean, accept_encoding string, accept_language string,
referer string, signals array<string>, ja4 string, listener string, resource string, content_hash string,
fork_of string, indicators {INDICATORS}, indicator_locations array<string>, attacks array<{ATTACK}>,
tools array<struct<name string, kind string>>, oast array<string>,
honeytokens array<struct<kind string, location string, minted_at double, age_s double, same_ip boolean, token string>>,
body_len bigint, body_sha256 string, body_truncated boolean, content_length bigint, body string, body_encoding string,
standard string, token string, extra_tokens map<string,string>, minted_at double, delay_seconds double,
same_ip boolean, same_ua boolean, split_fleet boolean, disallowed boolean, claimed string, verdict string,
detail string, rdns string, matched_range string, family string, target string, category string, intent string,
mitre array<string>, body_bytes bigint, decoy_served boolean, honeytokens_issued array<struct<kind string, token string>>,
web_attack string, stage boolean, persona string, scheme string, source string, user string, password string,
port int, sni string, alpn array<string>, versions array<string>, handshake_ok boolean, error string,
duration_ms double, first_bytes string, event string, origin string, pages bigint
"""
