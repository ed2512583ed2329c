"""A paged service for tests."""


class Client:
    def __init__(self, options):
        self.total = int(options["total"])

    def count(self):
        return self.total

    def page(self, offset, size):
        return [{"id": i, "title": f"t{i}", "content": "x"} for i in range(offset, min(offset + size, self.total))]


class Filtering:
    """A service that can filter by type, and that remembers in a file what it was asked for."""

    pushable = ("doc_type",)

    def __init__(self, options):
        self.log, self.items = options["log"], [{"id": i, "doc_type": "ab"[i % 2], "content": str(i)} for i in range(20)]

    def _of(self, where):
        assert all(column == "doc_type" and operator == "=" for column, operator, _ in where)
        return [x for x in self.items if all(x["doc_type"] == value for _, _, value in where)]

    def count(self, where=()):
        return len(self._of(where))

    def page(self, offset, size, where=()):
        found = self._of(where)[offset : offset + size]
        with open(self.log, "a") as f:
            f.write(f"{list(where)} {len(found)}\n")
        return found


class Growing:
    """A service whose number of items stands in a file."""

    def __init__(self, options):
        self.file = options["count"]

    def count(self):
        with open(self.file) as f:
            return int(f.read())

    def page(self, offset, size):
        return [{"id": i} for i in range(offset, offset + size)]
