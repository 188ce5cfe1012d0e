"""Rows of the tables that a module writes between its steps."""


def recorded(monkeypatch, module):
    seen, write = {}, module.written

    def count(df, name):
        table = write(df, name)
        seen[name] = seen.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(module, "written", count)
    return seen
