"""The eight built-in detections, as rule mappings.

Fixed values (must equal the reference for equal alerts): ids, titles,
levels, descriptions, selection values, conditions, threshold settings.
"""

from __future__ import annotations

import copy

from vigil.operators.rules import Rule, load_rule

BUILTIN_RULES = [
    {
        "title": "Failed SSH Login", "id": "gs-001", "level": "high",
        "description": "Detects failed SSH login attempts indicating potential unauthorized access.",
        "detection": {"selection": {"message|contains": "Failed password"}, "condition": "selection"},
    },
    {
        "title": "SSH Brute Force Attempt", "id": "gs-002", "level": "critical",
        "description": "Detects 5+ failed SSH logins from same IP in 60s, indicating brute force.",
        "detection": {
            "selection": {"message|contains": "Failed password"},
            "threshold": {"field": "src_ip", "value": 5},
            "timeframe": "60s",
            "condition": "selection",
        },
    },
    {
        "title": "SSH Login From Unusual Source", "id": "gs-003", "level": "medium",
        "description": "Detects successful SSH logins which may originate from unusual or external sources.",
        "detection": {"selection": {"message|contains": "Accepted"}, "condition": "selection"},
    },
    {
        "title": "Sudo Command Executed", "id": "gs-004", "level": "medium",
        "description": "Detects execution of commands via sudo, which may indicate privilege escalation.",
        "detection": {
            "selection": {"message|contains": "COMMAND="},
            "filter": {"message|contains": "pam_unix"},
            "condition": "selection and not filter",
        },
    },
    {
        "title": "New User Account Created", "id": "gs-005", "level": "high",
        "description": "Detects creation of new user accounts via useradd or adduser.",
        "detection": {
            "selection_useradd": {"message|contains": "useradd"},
            "selection_adduser": {"message|contains": "adduser"},
            "selection_newuser": {"message|contains": "new user"},
            "condition": "1 of selection*",
        },
    },
    {
        "title": "Service Started or Stopped", "id": "gs-006", "level": "low",
        "description": "Detects system service state changes which may indicate tampering or maintenance.",
        "detection": {
            "selection_started": {"message|contains": "Started"},
            "selection_stopped": {"message|contains": "Stopped"},
            "selection_systemctl": {"message|contains": "systemctl"},
            "condition": "1 of selection*",
        },
    },
    {
        "title": "Firewall Rule Change Detected", "id": "gs-007", "level": "high",
        "description": "Detects modifications to firewall rules via iptables or ufw.",
        "detection": {
            "selection_iptables": {"message|contains": "iptables"},
            "selection_ufw": {"message|contains": "ufw"},
            "filter_status": {"message|contains": "STATUS"},
            "condition": "1 of selection* and not filter_status",
        },
    },
    {
        "title": "Large Outbound Data Transfer Indicator", "id": "gs-008",
        "level": "high",
        "description": "Detects log entries indicating large outbound transfers, potential exfil.",
        "detection": {
            "selection_scp": {"message|contains": "scp"},
            "selection_rsync": {"message|contains": "rsync"},
            "selection_curl_upload": {"message|contains": "curl"},
            "selection_wget": {"message|contains": "wget"},
            "condition": "1 of selection*",
        },
    },
]


def builtin_rules() -> list[Rule]:
    """Fresh Rule objects for all eight built-ins, in order."""
    return [load_rule(copy.deepcopy(r)) for r in BUILTIN_RULES]


def builtin_rule(rule_id: str) -> Rule:
    return next(r for r in builtin_rules() if r.id == rule_id)
