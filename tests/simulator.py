"""A row-at-a-time simulator of a reorder buffer with deduplication, written from the operators' description alone."""


class Reorder:
    """submit() gives what leaves, in order; flush() the rest. Time-outs release one head an entity and call."""

    def __init__(self, timeout=None):
        self.timeout, self.next, self.wait, self.gaps = timeout, {}, {}, []

    def submit(self, entity, seq, item, now=0):
        if entity not in self.next:
            self.next[entity] = seq + 1
            return "FIRST", [(seq, item)]
        if seq < self.next[entity]:
            return "LATE", []
        self.wait.setdefault(entity, {})
        if seq > self.next[entity]:
            was = self.wait[entity].get(seq)
            self.wait[entity][seq] = (now, item)
            return ("BUFFERED" if was is None else "REPLACED"), []
        self.next[entity] += 1
        return "IN_ORDER", [(seq, item), *self._run(entity)]

    def _run(self, entity):
        out = []
        while self.next[entity] in self.wait.get(entity, {}):
            seq = self.next[entity]
            out.append((seq, self.wait[entity].pop(seq)[1]))
            self.next[entity] = seq + 1
        return out

    def timed_out(self, now):
        out = []
        for entity in sorted(e for e, w in self.wait.items() if w):
            head = min(self.wait[entity])
            if self.wait[entity][head][0] < now - self.timeout:
                if head > self.next[entity]:
                    self.gaps.append((entity, self.next[entity], head - 1))
                self.next[entity] = head
                out += [(entity, *x) for x in self._run(entity)]
        return out

    def flush(self):
        return [(e, seq, self.wait[e][seq][1]) for e in sorted(self.wait) for seq in sorted(self.wait[e])]
