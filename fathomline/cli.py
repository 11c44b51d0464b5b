"""``python -m fathomline.cli check | fix | gate [rule...] [save] [--config p] [-- command]``."""

from __future__ import annotations

import signal
import subprocess
import sys

from . import config as cfg
from . import engine
from .session import local_session


def parse(argv: list[str]) -> dict:
    out = {"mode": None, "rules": [], "save": False, "config": None, "root": ".", "command": []}
    if "--" in argv:
        k = argv.index("--")
        argv, out["command"] = argv[:k], argv[k + 1 :]
    rest = iter(argv)
    for a in rest:
        if a in ("--config", "--root"):
            value = next(rest, None)
            if value is None:
                raise cfg.ConfigError("usage", f"{a} needs a value")
            out[a[2:]] = value
        elif out["mode"] is None and a in ("check", "fix", "gate"):
            out["mode"] = a
        elif a == "save":
            out["save"] = True
        else:
            out["rules"].append(a)
    if out["mode"] is None:
        raise cfg.ConfigError("usage", "say check, fix or gate")
    if out["mode"] == "gate" and not out["command"]:
        raise cfg.ConfigError("usage", "gate needs a command after --")
    return out


def gate(command: list[str]) -> int:
    """Run the command with our streams; signals go on to it, its code comes back."""
    child = subprocess.Popen(command)
    old = {s: signal.signal(s, lambda n, _: child.send_signal(n)) for s in (signal.SIGINT, signal.SIGTERM, signal.SIGHUP, signal.SIGQUIT)}
    try:
        code = child.wait()
    finally:
        for s, handler in old.items():
            signal.signal(s, handler)
    return 128 - code if code < 0 else code


def main(argv: list[str] | None = None) -> int:
    try:
        args = parse(sys.argv[1:] if argv is None else argv)
        raw = cfg.load_config(args["root"], args["config"])
        runner = engine.Runner(local_session(), args["root"], raw)
        result = runner.fix(args["rules"]) if args["mode"] == "fix" else runner.check(args["rules"])
    except cfg.ConfigError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 1
    print(engine.render(result, (raw.get("logging") or {}).get("warnings", True)))
    if args["save"]:
        print(engine.save_report(f"{args['root']}/.fathomline/reports", result))
    if not result.ok:
        return 1
    return gate(args["command"]) if args["mode"] == "gate" else 0


if __name__ == "__main__":
    sys.exit(main())
