"""The rules that come with the package. Any directory of Sigma rules can be loaded instead.

They look for requests an operator of a web service may want to see, and between them use
every way of comparing that the compiler knows.
"""

from loghelm.operators.sigma import RulePack, compile_pack


def _rule(rule_id: str, title: str, level: str, condition: str, status: str = "stable", **selections) -> dict:
    detection = {**selections, "condition": condition}
    return {"id": rule_id, "title": title, "level": level, "status": status, "detection": detection}


# What each rule looks for.
DEFAULT_RULES = [
    # whole values, lists of numbers, not
    _rule("lh-refused-login", "Refused sign-in", "low", "door and refused and not agentless",
          door={"url": ["/login", "/session/new"]}, refused={"sc-status": [401, 403]}, agentless={"c-useragent": None}),
    # startswith
    _rule("lh-staff-area", "Staff area visited from a script", "medium", "area and client",
          area={"cs-uri-stem|startswith": ["/admin", "/internal"]},
          client={"c-useragent|startswith": ["curl/", "go-http-client/", "sqlmap/"]}),
    # endswith
    _rule("lh-settings-file", "Settings file asked for", "high", "file",
          file={"cs-uri-stem|endswith": ["/.env", "/settings.py", "/application.yml"]}),
    # extension
    _rule("lh-dump", "Archive or dump asked for", "medium", "dump", "test",
          dump={"c-uri-extension": ["sql", "bak", "tgz", "env"]}),
    # contains
    _rule("lh-parent-folder", "Path climbs to a parent folder", "high", "climb",
          climb={"url|contains": "/../"}),
    # contains with all
    _rule("lh-two-tables", "Query joins a second table", "critical", "both", both={"cs-uri-query|contains|all": ["union", "password"]}),
    # re
    _rule("lh-chained-command", "Command chained to a value", "critical", "chain", "experimental",
          chain={"cs-uri-query|re": r"=[^&]*[;|]\s*[a-z]+ /"}),
    # cidr, or, parentheses
    _rule("lh-office-errors", "Server error or redirect seen from an office network", "low", "office and (broken or moved)",
          office={"src_ip|cidr": ["10.0.0.0/26", "fd00::/8"]}, broken={"sc-status": 500}, moved={"sc-status": 302}),
    # null
    _rule("lh-silent-change", "Change without a user agent", "medium", "silent and not read",
          silent={"c-useragent": None}, read={"cs-method": ["GET", "HEAD", "OPTIONS"]}),
    # wildcards
    _rule("lh-crawler-version", "Crawler of the second generation", "informational", "crawler",
          crawler={"c-useragent": ["*bot/2.?;*", "*spider/2.?;*"]}),
    # keywords
    _rule("lh-markup", "Markup in a request", "high", "keywords", keywords=["<script", "<svg/onload", "%3cobject"]),
    # keywords with a wildcard
    _rule("lh-account-file", "Account file named", "high", "keywords", "test", keywords=["cat /*/passwd"]),
    # list of mappings
    _rule("lh-watchers", "Monitor or scanner", "low", "either",
          either=[{"c-useragent|contains": "pingdom"}, {"c-useragent|contains": "sqlmap", "cs-method": "GET"}]),
    # 1 of, all of
    _rule("lh-odd-sale", "Sale that failed or came without a browser", "medium", "all of need_* and 1 of odd_*", "experimental",
          need_method={"cs-method": "POST"}, need_path={"url|contains": "/purchase/"},
          odd_status={"sc-status": [500, 503]}, odd_client={"c-useragent|startswith": ["curl", "sqlmap"]}),
    # them
    _rule("lh-first-page", "First page of a signup", "informational", "all of them", path={"url|startswith": "/signup/"}, page={"cs-uri-query|endswith": "=0"}),
]


def default_pack() -> RulePack:
    return compile_pack(DEFAULT_RULES)
