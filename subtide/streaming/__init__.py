"""State machines of live sessions, run over tables by a sorted fold and over streams by keyed state."""
