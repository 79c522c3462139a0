"""Masking rules and mining parameters of the known log formats."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """One ordered substitution; flags are names such as IGNORECASE."""

    pattern: str
    replacement: str = "<*>"
    flags: tuple[str, ...] = ()
    name: str = ""


@dataclass(frozen=True)
class Params:
    """Entropy limit of an anchor, positions looked at, least similarity, and messages folded per cluster."""

    entropy_threshold: float = 1.5
    max_check_positions: int = 10
    min_similarity: float = 0.6
    sample_size: int = 50

    def __post_init__(self) -> None:
        for name in ("max_check_positions", "sample_size"):
            v = getattr(self, name)
            if isinstance(v, bool) or not isinstance(v, int) or v <= 0:
                raise ValueError(f"{name} must be a positive integer")
        if isinstance(self.entropy_threshold, bool) or not isinstance(self.entropy_threshold, (int, float)) or self.entropy_threshold < 0:
            raise ValueError("entropy_threshold must be a number of at least 0")
        if isinstance(self.min_similarity, bool) or not isinstance(self.min_similarity, (int, float)) or not 0 <= self.min_similarity <= 1:
            raise ValueError("min_similarity must be within 0 and 1")


DEFAULT_FORMAT = "loghub"
ALIASES = {"proxifier": "loghub"}
#: Every format's rules end with this one, and its lines are stripped.
SPACES = Rule(r"\s+", " ")

# The patterns decide what is masked, in this order.
_IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
_PATH = r"(/[a-zA-Z0-9_.=-]+)+"
_HEX = r"\b0x[a-fA-F0-9]+\b"
_INT = r"\b\d+\b"
_HOST_PORT = r"/?\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?\b"
RULES: dict[str, tuple[Rule, ...]] = {
    "loghub": (
        Rule(r"[a-zA-Z0-9.-]+:\d+"),
        Rule(r"proxy\.[a-zA-Z0-9.-]+"),
        Rule(r"<\d+\ssec", "<*>", ("IGNORECASE",)),
        Rule(r"\b\d{2}:\d{2}(:\d{2})?\b"),
        Rule(r"\d+(\.\d+)?\s[KM]B"),
        Rule(_INT),
        Rule(r"\(IPv6\)"),
        SPACES,
    ),
    "linux": (
        Rule(_IPV4),
        Rule(r"\b([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})\b"),
        Rule(r"[A-Z][a-z]{2} [A-Z][a-z]{2}\s+\d+ \d{2}:\d{2}:\d{2} \d{4}"),
        Rule(r"\buser [a-zA-Z0-9_.-]+\b", "user <*>"),
        Rule(r"\(uid=\d+\)"),
        Rule(r"\(\)", "(<*>)"),
        Rule(r"([a-zA-Z_]+)=([^\s]*)", r"\1=<*>"),
        Rule(r"\[\d+\]"),
        Rule(_HEX),
        Rule(_INT),
        SPACES,
    ),
    "hdfs": (
        Rule(_HOST_PORT),
        Rule("blk_(|-)[0-9]+"),
        Rule(_PATH),
        Rule(_INT),
        SPACES,
    ),
    "mac": (
        Rule(" '([^']+)'", " <*>"),
        Rule("^'([^']+)'"),
        Rule(r"Sandbox: ([a-zA-Z0-9.-]+)\(\d+\) deny\(\d+\)", r"Sandbox: \1(<*>) deny(<*>)"),
        Rule(r"^([a-zA-Z0-9.-]+)\(\d+\) deny network-outbound", "<*>(<*>) deny network-outbound"),
        Rule(r"([a-zA-Z0-9.-]+)\(\d+\)", r"\1(<*>)"),
        Rule(r"\[\d{4}-\d{2}-\d{2}_[^\]]+\][^\s,]*"),
        Rule(r"(source path:|dest path:)[^\s,]+", r"\1<*>"),
        Rule(r"\b(en|wl|eth)\d+:", "<*>:"),
        Rule(r"WWEN\[.*?\]", "WWEN[<*>]"),
        Rule("Wake reason: .*", "Wake reason: <*>"),
        Rule(r'(URL: |url=)"?https?://[^\s"]+"?', r'\1"<*>"'),
        Rule(r"[a-zA-Z0-9_]+<\d+>"),
        Rule(r"\b\d+\.\d+\b"),
        Rule(r"\b([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})\b"),
        Rule(r"\b([a-fA-F0-9]{1,4}:){2,7}[a-fA-F0-9]{1,4}\b"),
        Rule(r"\bIPV[46]\b", "<*>", ("IGNORECASE",)),
        Rule(r"\b\d{2}:\d{2}:\d{2}\b"),
        Rule(_HEX),
        Rule(_IPV4),
        Rule(r"\bdisk\d+s\d+\b"),
        Rule(_PATH),
        Rule(r"\[\d+\]", "[<*>]"),
        Rule(_INT),
        SPACES,
    ),
    "apache": (
        Rule(r"\[client \b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?\b\]", "[client <*>]"),
        Rule(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?\b"),
        Rule(_PATH),
        Rule(_INT),
        SPACES,
    ),
    "hadoop": (
        Rule(r"[a-zA-Z0-9.-]+/[0-9.]+:\d+"),
        Rule(r"[a-zA-Z0-9.-]+:\d+"),
        Rule(r"\b(job|task|attempt|application|container)_[0-9a-zA-Z_]+\b"),
        Rule(_PATH),
        Rule(r"[a-zA-Z0-9.]+\@[a-fA-F0-9]+"),
        Rule(r"\d+/\d+"),
        Rule(_HOST_PORT),
        Rule("blk_(|-)[0-9]+"),
        Rule(r"\b\d{10,}\b"),
        Rule(_HEX),
        Rule(_INT),
        SPACES,
    ),
    "bgl": (
        Rule(_PATH),
        Rule(r"(?<=program )[^\s]+"),
        Rule(r"mc=[^\s\)]+", "mc=<*>"),
        Rule(r"\b[0-9a-fA-F]{8,}\b"),
        Rule(r"\b[A-Z]\d{2}\b"),
        Rule(r"Source file=[^\s]+", "Source file=<*>"),
        Rule("Function=.*", "Function=<*>"),
        Rule(r"chdir\([^\)]+\)", "chdir(<*>)"),
        Rule(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}:\d+\b"),
        Rule(r"\b[A-Z0-9]+-[A-Z0-9]+-[A-Z0-9]+-[A-Z0-9:]+\b"),
        Rule(r"\b\d{4}-\d{2}-\d{2}-\d{2}\.\d{2}\.\d{2}\.\d+\b"),
        Rule(r"\b\d{4}\.\d{2}\.\d{2}\b"),
        Rule(_HEX),
        Rule(r"(Target|Message|SerialNumber|IpAddress|Status)=([^\s]+)", r"\1=<*>"),
        Rule(r"(SerialNumber|IpAddress|Status)\([^\)]+\)", r"\1(<*>)"),
        Rule(_INT),
        SPACES,
    ),
    "healthapp": (
        Rule(r"type=\d+,\d+(?:\.\d+)?", "type=<*>"),
        Rule("action:[a-zA-Z0-9._]+", "action:<*>"),
        Rule("packageName = [a-zA-Z0-9._]+", "packageName = <*>"),
        Rule(r"steps\d+mLastReport\d+"),
        Rule(r"\b\d+(?:##\d+)+\b"),
        Rule(r"REPORT : \d+(?: \d+)+", "REPORT : <*>"),
        Rule(r"totalSteps=\d+Calories:\d+Floor:\d+Distance:[\d.]+", "totalSteps=<*>"),
        Rule(r"\b\d+\.\d+\b"),
        Rule(_INT),
        Rule(_HEX),
        SPACES,
    ),
    "hpc": (
        Rule(r"\b(node-|r\d+i\d+n\d+)[a-zA-Z0-9_-]*\b", "<*>", ("IGNORECASE",)),
        Rule(r"[a-zA-Z0-9_-]+\[\d+\]"),
        Rule(_PATH),
        Rule(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?\b"),
        Rule(_HEX),
        Rule(_INT),
        SPACES,
    ),
    "openssh": (
        Rule(r"(?<=maps to )[^\s,]+"),
        Rule(r"Disconnecting: Too many authentication failures for [^\s]+", "Disconnecting: Too many authentication failures for <*>"),
        Rule(r"reverse mapping checking getaddrinfo for [^\s]+ \[", "reverse mapping checking getaddrinfo for <*> ["),
        Rule(r"(?<=for )[^\s]+(?= from)"),
        Rule(r"(?<=user )[^\s]+(?= from| by)"),
        Rule(r"\b(logname|uid|euid|tty|ruser|rhost|user)=([^\s\)]*)", r"\1=<*>"),
        Rule(r"sshd\[\d+\]", "sshd[<*>]"),
        Rule(_IPV4),
        Rule(r"\bport \d+\b", "port <*>"),
        Rule(_HEX),
        Rule(_INT),
        SPACES,
    ),
    "openstack": (
        Rule(r"\b\d{1,3}(?:\.\d{1,3}){3}(?:,\d{1,3}(?:\.\d{1,3}){3})*\b"),
        Rule(r"HTTP/\d\.\d"),
        Rule(r"\b\d+\.\d+\b"),
        Rule(_PATH),
        Rule(r"name=[^\s]+", "name=<*>"),
        Rule(r"\b\d+[MG]B\b"),
        Rule(r"pci_stats=\[.*?\]", "pci_stats=<*>"),
        Rule("req-[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}", "req-<*>"),
        Rule(r"\b[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}\b"),
        Rule(_HEX),
        Rule(_INT),
        SPACES,
    ),
    "thunderbird": (
        Rule(r"Sending on [^\s]+", "Sending on <*>"),
        Rule(r"Type:\s+[a-zA-Z-]+\s+ANSI SCSI revision:", "Type: <*> ANSI SCSI revision:"),
        Rule(r"\b([a-zA-Z0-9_.-]+)\s+(startup|shutdown) succeeded", r"<*> \2 succeeded"),
        Rule(r"Listening on interface [^\s,]+, .*", "Listening on interface <*>, <*>"),
        Rule(r"\b\d{4}-\d{2}-\d{2}\b"),
        Rule(r"DHCPREQUEST for \d{1,3}(?:\.\d{1,3}){3} \(\d{1,3}(?:\.\d{1,3}){3}\)", "DHCPREQUEST for <*>"),
        Rule(r"\b\d{1,3}(?:\.\d{1,3}){3}#\d+\b"),
        Rule(r"\(level, [^)]+\)", "(level, <*>)"),
        Rule(r"\bvia [^\s:]+:", "via <*>:"),
        Rule(r"\bnetwork [^\s:]+:", "network <*>:"),
        Rule("^[a-zA-Z0-9]+: (?=from=)", "<*>: "),
        Rule(r"\b(from|size|class|nrcpts|msgid|relay)=[^,\s]+", r"\1=<*>"),
        Rule(r"\[CPU\d+\]", "[<*>]"),
        Rule(r"\(supports [^)]+\)", "(supports <*>)"),
        Rule("Sensor location: .*? Chassis location:", "Sensor location: <*> Chassis location:"),
        Rule("Chassis location: .*? Previous state was:", "Chassis location: <*> Previous state was:"),
        Rule("Previous state was: [A-Za-z]+", "Previous state was: <*>"),
        Rule(r"\[[a-zA-Z0-9_.-]+\.c:\d+\]", "[<*>]"),
        Rule("(?<=data source name ).*"),
        Rule(r"user [^\s]+ by ([^\s\)]*)\(uid=", "user <*> by <*>(uid="),
        Rule(r"\[/[^\]]+\]", "[<*>]"),
        Rule(r"for [^\s]+ port", "for <*> port"),
        Rule(r"\([^\)]+\) CMD \([^)]+\)", "(<*>) CMD (<*>)"),
        Rule("map_list = [0-9a-fA-F]+", "map_list = <*>"),
        Rule(r"\b[0-9a-fA-F]{8,}\b"),
        Rule(_PATH),
        Rule(_IPV4),
        Rule(r"\b\d+\.\d+\b"),
        Rule(_HEX),
        Rule(_INT),
        SPACES,
    ),
    "zookeeper": (
        Rule("error =.*", "error =<*>"),
        Rule(r"(Expiring session [^,]+),\s*timeout of \d+ms", r"\1 timeout of <*>"),
        Rule(r"[a-zA-Z0-9_x]+\s+(?=\(n\.[a-zA-Z]+\)|\(my state\))", "<*> "),
        Rule("^shutting down", "Shutting down"),
        Rule(r"\[myid:\d+\]", "[myid:<*>]"),
        Rule(r"\[[a-zA-Z0-9_-]+:\d+\]", "[<*>]"),
        Rule(_HOST_PORT),
        Rule(r"\b0x[a-fA-F0-9]{8,}\b"),
        Rule(_PATH),
        Rule(_HEX),
        Rule(_INT),
        SPACES,
    ),
    "spark": (
        Rule(r"[a-zA-Z]+://[^\s]+"),
        Rule(r"'?\b(application|app|job|stage|task|attempt|appattempt)_[0-9a-zA-Z_-]+\b'?"),
        Rule(r"TID\s+\d+", "TID <*>"),
        Rule(r"\btask \d+\.\d+ in stage \d+\.\d+\b", "task <*> in stage <*>"),
        Rule(r"executor \d+", "executor <*>"),
        Rule(r"\bBP-[a-zA-Z0-9.-]+:blk_[0-9_-]+\b"),
        Rule(r"\bblk_[0-9_-]+\b"),
        Rule("block_?mgr_[a-zA-Z0-9_-]+"),
        Rule(r"rdd_\d+_\d+"),
        Rule(r"shuffle_\d+_\d+_\d+"),
        Rule(r"broadcast_\d+(_piece\d+)?"),
        Rule(r"\b\d+(\.\d+)?\s*(B|KB|MB|GB|TB)\b"),
        Rule(r"\b\d+(\.\d+)?\s*(ms|s|min)\b"),
        Rule(r"\bmesos-slave-[a-zA-Z0-9_-]+\b"),
        Rule(_HOST_PORT),
        Rule(_PATH),
        Rule(r"\b[a-fA-F0-9]{8,}\b"),
        Rule(_HEX),
        Rule(_INT),
        SPACES,
    ),
}

# Parameters that differ from the defaults, by format.
PARAMS: dict[str, Params] = {
    "hdfs": Params(1.0, 15, 0.85),
    "hadoop": Params(1.0, 15, 0.65),
    "hpc": Params(1.5, 12, 0.65),
    "thunderbird": Params(1.5, 12, 0.65),
    "openssh": Params(1.5, 12, 0.65),
    "spark": Params(1.5, 12, 0.65),
    "zookeeper": Params(1.5, 12, 0.65),
    "bgl": Params(1.5, 12, 0.88),
    "healthapp": Params(1.5, 10, 0.85),
    "openstack": Params(1.5, 12, 0.75),
    "mac": Params(2.5, 12, 0.50),
}
#: One setting for every format, for experiments that do not tune.
UNIFORM = Params(1.5, 12, 0.65)


def resolve(name: str) -> str:
    """The format a data set's name stands for: its own, an alias's, or the default."""
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    return key if key in RULES else DEFAULT_FORMAT


def formats() -> tuple[str, ...]:
    return tuple(sorted(RULES))


def params(name: str) -> Params:
    return PARAMS.get(name.strip().lower(), Params())
