"""A transport whose first calls of each day fail; it counts calls in files, as tasks share no memory."""

import os
import uuid

from ledgerline.sources.feeds import ParquetTransport


class Flaky(ParquetTransport):
    def fetch(self, feed, key, first, last):
        folder = f"{self.options['counts']}/{first}-{key}"
        os.makedirs(folder, exist_ok=True)
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        if len(os.listdir(folder)) <= int(self.options["failures"]):
            raise OSError(f"no answer for {first}")
        return super().fetch(feed, key, first, last)
