"""Command line for rules: dump, list, validate, path, reset, convert."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from webquarry.operators import rules


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="webquarry rules")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("dump", "list", "validate", "path", "reset", "convert"):
        command = commands.add_parser(name)
        command.add_argument("--rules", default="")
        if name == "convert":
            command.add_argument("groups", type=Path)
        if name in ("dump", "reset", "convert"):
            command.add_argument("--force", action="store_true")
        if name in ("dump", "convert"):
            command.add_argument("to", type=Path)
    args = parser.parse_args(argv)
    user = rules.user_path()
    if args.command == "path":
        print(f"flag: {args.rules or '-'}\nenvironment: {rules.RULES_ENV}\nuser: {user}{'' if user.exists() else ' (missing)'}\nembedded: {len(rules.embedded().rules)} rules")
        return 0
    if args.command in ("dump", "reset", "convert"):
        to = user if args.command == "reset" else args.to
        if to.exists() and not args.force:
            print(f"{to} exists; use --force", file=sys.stderr)
            return 1
        to.parent.mkdir(parents=True, exist_ok=True)
        if args.command == "convert":  # the rules in use, and those of a file of groups before them
            found, notes = rules.from_groups(args.groups.read_text())
            print("".join(f"{note}\n" for note in notes), end="", file=sys.stderr)
            to.write_text(rules.to_yaml(rules.merged(found, rules.load(args.rules).rules)))
        else:
            to.write_text(rules.to_yaml(rules.embedded()))
        print(to)
        return 0
    found = rules.load(args.rules)
    if args.command == "list":
        for rule in sorted(found.rules, key=lambda r: (r.group, r.id)):
            print(f"{rule.group}\t{rule.id}\t{rule.kind}\t{rule.pattern[:60]}")
    else:
        for name, error in found.errors.items():
            print(f"{name}: {error}", file=sys.stderr)
        print(f"{len(found.rules)} rules from {found.source}, {len(found.errors)} with errors")
    return int(args.command == "validate" and bool(found.errors))


if __name__ == "__main__":
    sys.exit(main())
