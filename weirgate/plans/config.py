"""Settings, all immutable and checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from types import MappingProxyType

#: Root of every rule id; callers who keep ids of another system name theirs.
NAMESPACE = "weirgate"
SYNTACTIC = f"{NAMESPACE}.syntactic"
SEVERITIES = ("low", "medium", "high", "critical")
TIERS = ("none", "tier1", "tier2", "tier3")
VERBOSITIES = ("minimal", "standard", "high", "maximum")


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _positive(x, name: str) -> None:
    _check(isinstance(x, (int, float)) and math.isfinite(x) and x > 0, f"{name} must be finite and above 0")


@dataclass(frozen=True)
class PrefilterConfig:
    max_payload_bytes: int = 524_288
    max_json_depth: int = 10
    suppress: tuple[str, ...] = ()

    def __post_init__(self):
        _positive(self.max_payload_bytes, "max_payload_bytes")
        _positive(self.max_json_depth, "max_json_depth")
        _check(self.max_json_depth <= 1000, "max_json_depth must be at most 1000")


@dataclass(frozen=True)
class Variant:
    required: tuple[str, ...] = ()
    fields: tuple[tuple[str, str], ...] = ()
    allow_extra: bool = False


@dataclass(frozen=True)
class ToolSchema:
    variants: tuple[tuple[str, Variant], ...]
    discriminant: str | None = None


@dataclass(frozen=True)
class SchemaConfig:
    enabled: bool = False
    strict: bool = True
    schemas: tuple[tuple[str, ToolSchema], ...] = ()

    def __post_init__(self):
        for key, schema in self.schemas:
            parts = key.split(":")
            _check(len(parts) == 2 and all(parts), f"schema key {key!r} must be server:tool")
            _check(len(schema.variants) > 0, f"schema {key!r} has no variants")
            for _, v in schema.variants:
                _check(all(t in ("string", "number", "boolean", "object", "array", "null") for _, t in v.fields), f"schema {key!r} has an unknown type")


@dataclass(frozen=True)
class ScannerConfig:
    enabled: bool = True
    threshold: str = "low"
    direction: str = "inbound"

    def __post_init__(self):
        _check(self.threshold in SEVERITIES, "unknown threshold")
        _check(self.direction in ("inbound", "outbound", "both"), "unknown direction")


@dataclass(frozen=True)
class SanitizeConfig:
    enabled: bool = True
    placeholder: str = "[REDACTED]"
    include_rule: bool = False
    redact_all: bool = False
    hash_redactions: bool = False
    hmac_key: str | None = None


DEFAULT_WEIGHTS = MappingProxyType({
    f"{NAMESPACE}.prompt_injection.*": 10.0, f"{NAMESPACE}.credential.*": 10.0, f"{NAMESPACE}.structural.*": 5.0,
    f"{NAMESPACE}.schema.extra-field": 8.0, f"{NAMESPACE}.schema.type-mismatch": 6.0, f"{NAMESPACE}.schema.missing-field": 4.0,
    f"{NAMESPACE}.schema.undeclared-admin-reject": 4.0,
})


@dataclass(frozen=True)
class FrequencyConfig:
    enabled: bool = True
    half_life_ms: float = 60_000
    weights: MappingProxyType = field(default_factory=lambda: DEFAULT_WEIGHTS)
    thresholds: tuple[float, float, float] = (15, 30, 50)
    rolling_window_ms: int = 3_600_000
    rolling_threshold: int = 10
    ttl_ms: int = 3_600_000
    #: Over these, sessions are evicted or refused in one global order; off unless strict_capacity is set.
    max_sessions: int = 10_000
    max_new_sessions_per_minute: int = 100
    strict_capacity: bool = False

    def __post_init__(self):
        a, b, c = self.thresholds
        _check(a < b < c and all(map(math.isfinite, self.thresholds)), "thresholds must ascend strictly")
        _positive(self.half_life_ms, "half_life_ms")
        _positive(self.rolling_window_ms, "rolling_window_ms")
        _check(isinstance(self.rolling_threshold, int) and self.rolling_threshold >= 1, "rolling_threshold must be a whole number of at least 1")
        _check(isinstance(self.max_new_sessions_per_minute, int) and self.max_new_sessions_per_minute >= 1, "max_new_sessions_per_minute must be a whole number of at least 1")
        _check(all(math.isfinite(w) and w >= 0 for w in self.weights.values()), "weights must be finite and not negative")

    @property
    def exact(self) -> dict[str, float]:
        return {k: w for k, w in self.weights.items() if not k.endswith(".*")}

    @property
    def globs(self) -> list[tuple[str, float]]:
        """Prefixes with their dot, the longest first."""
        return sorted(((k[:-1], w) for k, w in self.weights.items() if k.endswith(".*")), key=lambda x: -len(x[0]))


@dataclass(frozen=True)
class Profile:
    name: str
    suppress: tuple[str, ...] = ()
    weights: tuple[tuple[str, float], ...] = ()
    thresholds: tuple[float, float, float] | None = None
    audit_floor: str = "minimal"
    strictness: str = "strict"

    def prefilter(self, base: PrefilterConfig) -> PrefilterConfig:
        return replace(base, suppress=base.suppress + self.suppress)

    def frequency(self, base: FrequencyConfig) -> FrequencyConfig:
        return replace(base, weights=MappingProxyType({**base.weights, **dict(self.weights)}), thresholds=self.thresholds or base.thresholds)


PROFILES = MappingProxyType({
    p.name: p
    for p in (
        Profile("general"),
        Profile("customer-service", weights=((f"{NAMESPACE}.credential.*", 15.0),), audit_floor="high"),
        Profile("code-generation", (f"{SYNTACTIC}.encoding.base64-in-text",), ((f"{SYNTACTIC}.encoding.*", 1.0), (f"{NAMESPACE}.credential.*", 12.0)), None, "standard", "lenient"),
        Profile("research", (f"{SYNTACTIC}.injection.role-switch-only",), ((f"{SYNTACTIC}.injection.role-switch-only", 2.0),), None, "standard", "lenient"),
        Profile("admin", (), ((f"{SYNTACTIC}.injection.*", 15.0), (f"{NAMESPACE}.credential.*", 15.0)), (10, 20, 35), "maximum"),
    )
})


def resolve_profile(profile: str | Profile, taxonomy: tuple[str, ...] = (), base: str | None = None) -> Profile:
    """A built-in by name, or a custom one checked and, if asked, merged over a built-in."""
    if isinstance(profile, str):
        _check(profile in PROFILES, f"unknown profile {profile!r}; known: {', '.join(PROFILES)}")
        return PROFILES[profile]
    _check(profile.name not in PROFILES, f"profile id {profile.name!r} is built in")
    unknown = [r for r in profile.suppress if taxonomy and r not in taxonomy]
    _check(not unknown, f"unknown rules: {unknown}")
    if base is not None:
        under = resolve_profile(base)
        profile = replace(profile, suppress=under.suppress + profile.suppress, weights=under.weights + profile.weights, thresholds=profile.thresholds or under.thresholds)
    if profile.thresholds:
        a, b, c = profile.thresholds
        _check(a < b < c, "thresholds must ascend strictly")
    return profile


@dataclass(frozen=True)
class AuditConfig:
    enabled: bool = True
    verbosity: str = "standard"
    alerting: bool = False

    def __post_init__(self):
        _check(self.verbosity in VERBOSITIES, "unknown verbosity")


@dataclass(frozen=True)
class AlertConfig:
    burst_count: int = 5
    burst_minutes: int = 10
    tier2_enabled: bool = True
    escalate_after: int = 3
    write_count: int = 3
    write_minutes: int = 5
    policy_count: int = 1
    policy_minutes: int = 10
    suppression_minutes: float = 5
    per_minute: int = 20
    per_hour: int = 100
    context: int = 20
    #: Rules that are off, by name; the one on terminated sessions always stays on.
    disabled: tuple[str, ...] = ()

    def __post_init__(self):
        _check(math.isfinite(self.suppression_minutes) and self.suppression_minutes >= 0, "suppression_minutes must be finite and not negative")
        _check(all(isinstance(x, int) and x >= 1 for x in (self.per_minute, self.per_hour)), "rate limits must be whole numbers of at least 1")
        _check(isinstance(self.context, int) and self.context >= 0, "context must be a whole number and not negative")


@dataclass(frozen=True)
class PipelineConfig:
    prefilter: PrefilterConfig = PrefilterConfig()
    schema: SchemaConfig = SchemaConfig()
    scanner: ScannerConfig = ScannerConfig()
    sanitize: SanitizeConfig = SanitizeConfig()
    frequency: FrequencyConfig = field(default_factory=FrequencyConfig)
    audit: AuditConfig = AuditConfig()
    alerts: AlertConfig = AlertConfig()
    two_pass: bool = False
    trusted_servers: tuple[str, ...] = ()
    hard_block: tuple[str, ...] = tuple(f"{SYNTACTIC}.injection.{x}" for x in ("ignore-previous", "system-override", "role-switch-capability"))

    def with_profile(self, profile: Profile) -> PipelineConfig:
        return replace(self, prefilter=profile.prefilter(self.prefilter), frequency=profile.frequency(self.frequency))


@dataclass(frozen=True)
class GuardConfig:
    exempt: tuple[str, ...] = ()
    restricted: tuple[str, ...] = ("read",)
    escalate_warnings: bool = True
    scan_params: bool = True


@dataclass(frozen=True)
class GatewayConfig:
    exempt_channels: tuple[str, ...] = ()
    exempt_senders: tuple[str, ...] = ()
    tier2_action: str = "warn"
    redact_outbound: bool = True
    block_message: str = "Message blocked by content filter."
    terminate_message: str = "Session terminated due to repeated violations."


def from_options(kind: type, options: dict):
    """A configuration from plain options; one that it doesn't have is refused."""
    from dataclasses import fields

    known = {f.name for f in fields(kind)}
    _check(set(options) <= known, f"unknown options: {sorted(set(options) - known)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in options.items()})


#: Settings of the host's plugin, which differ from the library's own.
HOST_FREQUENCY = FrequencyConfig(weights=MappingProxyType({**DEFAULT_WEIGHTS, f"{NAMESPACE}.prompt_injection.*": 15.0}), thresholds=(15, 40, 80), rolling_window_ms=300_000, ttl_ms=1_800_000)
HOST_SCANNER = ScannerConfig(threshold="medium")


@dataclass(frozen=True)
class HostConfig:
    """All settings of a host's plugin in one place, and the parts that follow from them."""

    inbound_profile: str | Profile = "general"
    outbound_profile: str | Profile = "customer-service"
    frequency: FrequencyConfig = HOST_FREQUENCY
    block_threshold: str = "medium"
    direction: str = "both"
    tier2_action: str = "warn"
    block_message: str = GatewayConfig.block_message
    terminate_message: str = GatewayConfig.terminate_message
    redact_outbound: bool = True
    hash_redactions: bool = True
    #: Without a key nothing is hashed.
    hmac_key: str | None = None
    audit_sink: str = "log"
    audit_verbosity: str = "standard"
    #: Kept for the host; nothing here reads it.
    alert_channel: str | None = None
    exempt_channels: tuple[str, ...] = ()
    exempt_senders: tuple[str, ...] = ()
    tool_guard_enabled: bool = True
    exempt_tools: tuple[str, ...] = ()
    restricted_tools: tuple[str, ...] = ("read",)
    escalate_warnings: bool = True
    scan_params: bool = True

    def __post_init__(self):
        _check(self.block_threshold in SEVERITIES, "unknown block_threshold")
        _check(self.direction in ("inbound", "outbound", "both"), "unknown direction")
        _check(self.tier2_action in ("warn", "block"), "unknown tier2_action")
        _check(self.audit_sink in ("log", "ingest", "both"), "unknown audit_sink")
        _check(self.audit_verbosity in VERBOSITIES, "unknown audit_verbosity")
        _check(bool(self.block_message) and bool(self.terminate_message), "messages must not be empty")

    def pipeline(self, side: str) -> PipelineConfig:
        """Settings of the inbound or outbound side. Sides share one tracker, so profiles change rules, not scores."""
        _check(side in ("inbound", "outbound"), "side must be inbound or outbound")
        profile = self.inbound_profile if side == "inbound" else self.outbound_profile
        profile = resolve_profile(profile) if isinstance(profile, str) else profile
        clean = SanitizeConfig(enabled=side == "inbound" or self.redact_outbound, hash_redactions=self.hash_redactions, hmac_key=self.hmac_key)
        return PipelineConfig(prefilter=profile.prefilter(PrefilterConfig()), scanner=ScannerConfig(threshold=self.block_threshold, direction=side), sanitize=clean, frequency=self.frequency, audit=AuditConfig(verbosity=self.audit_verbosity, alerting=True))

    @property
    def guard(self) -> GuardConfig | None:
        return GuardConfig(self.exempt_tools, self.restricted_tools, self.escalate_warnings, self.scan_params) if self.tool_guard_enabled else None

    @property
    def gateway(self) -> GatewayConfig:
        return GatewayConfig(self.exempt_channels, self.exempt_senders, self.tier2_action, self.redact_outbound, self.block_message, self.terminate_message)
