"""Five small corpora of our own with gold questions, for churn and retrieval measurements.

They are regression data: figures measured on them say nothing about other texts.
"""

from __future__ import annotations

from dataclasses import dataclass

KINDS = ("manual", "documentation", "legal", "code", "wiki")


@dataclass(frozen=True)
class Corpus:
    name: str
    kind: str
    documents: dict[str, str]

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}; there are {', '.join(KINDS)}")


@dataclass(frozen=True)
class Question:
    question_id: str
    corpus: str
    query: str
    evidence: tuple[str, ...]


_PUMP = """# Orchard pump handbook

This handbook covers the low pressure pump that feeds the orchard ponds. Read it once before the first season and keep a copy in the shed.

## Starting the pump

Open the inlet valve a quarter turn and wait until the sight glass shows no bubbles. Press the green switch and listen for a steady hum. A rattle means that air is trapped in the volute, so stop the pump and bleed it again. Never start the motor while the outlet hose is kinked.

## Weekly checks

Wipe the strainer basket every Monday and look for leaves, snail shells and torn mesh. The bearing housing may feel warm, but it should not be too hot to touch. Write the reading of the hour meter in the blue notebook. If the meter advanced by more than forty hours, add two strokes of grease to each bearing.

## Winter storage

Drain the casing through the lower plug before the first frost. Store the impeller wrapped in oiled paper, away from the mice. A cracked casing cannot be welded and must be replaced. Cover the motor with the canvas hood, but leave the vents open so that damp air can escape.

## Fault table

A pump that runs but moves no water has usually lost its prime. A pump that trips the breaker after a minute is often running against a closed valve. When the seal weeps more than ten drops a minute, order seal kit nineteen and fit it within the week. Call the miller if the shaft has play in both directions.
"""

_GATE = """# Sluice gate card

The sluice gate lifts with the brass crank beside the footbridge. Turn the crank eleven times for a half opening. Do not lift the gate while children are on the bridge.

Grease the rack in April with tallow. Record the water level on the painted staff before and after every change. The gate keeper signs the card on the last day of the month.
"""

_BIRDS = """# Field guide to the marsh

The marsh lies between the dike and the old brickworks. Most visitors come for the birds, yet the plants deserve a slow walk as well.

## Grey heron

The heron stands still in shallow water and strikes with a folded neck. It nests in alder trees from late February. Young herons clatter their bills when a parent returns. In flight the legs trail behind and the neck is drawn in, which tells the heron from the crane at any distance.

## Reed bunting

The male bunting wears a black hood and a white collar in spring. Its song is a short and halting phrase, repeated from the top of a stem. It feeds seeds to nobody but brings caterpillars to its young. Winter flocks mix with sparrows on stubble fields beyond the dike.

## Water rail

The rail is heard more often than seen, because it squeals like a small pig among the reeds. Look for it at dusk along the muddy margin, where it probes for snails. A hard frost drives the rail into the open. Count only the calls that you hear twice.

## Marsh marigold

The marigold flowers before the willows have leaves. Its buds were once pickled as capers, although the raw plant is bitter and mildly toxic. Cattle avoid it. Seeds float for weeks and settle where the current slackens, so the yellow bands follow the winter flood line.
"""

_TRAIL = """# Boardwalk notes

The boardwalk starts at the pumping house and returns after three kilometres. Planks near the second hide are slippery after rain. Dogs stay on a lead from March until July.

The western hide looks over the reserve in which the bittern was last recorded in the spring of the great flood. Bring boots, a lens and patience.
"""

_LEASE = """# Lease of the ferry house

This lease is made between the harbour board and the tenant named in the schedule. Words in the schedule have the same meaning in every clause.

## Rent

The tenant shall pay the rent on the first working day of each quarter. Rent that is more than fourteen days late shall bear interest at three percent above the base rate. The board may not raise the rent within the first five years. A receipt shall be given for every payment made in coin.

## Repairs

The board shall keep the roof, the walls and the landing stage in good repair. The tenant shall keep the windows, the stove and the inner doors in good repair. Damage by ice shall be reported within two days. The tenant shall not cut, pierce or paint the beams without written consent of the board.

## Use of the house

The house shall be used as a dwelling and as a ticket office only. No boat longer than nine metres shall be moored at the landing stage overnight. The tenant may sublet one room to a deckhand in the employ of the ferry. Fires on the landing stage are forbidden at all times.

## End of the lease

Either party may end the lease by notice of six months in writing. The tenant shall return all nine keys to the harbour office on the last day. Fixtures that cannot be removed without damage shall pass to the board. Disputes shall be heard by the arbiter of the district before any court is asked.
"""

_RULES = """# Harbour rules

Vessels under oars give way to the ferry within the outer mole. The speed limit inside the harbour is four knots. Nets may be dried on the northern quay only.

The harbour master may board any vessel to inspect its lights. A fine of twenty crowns is due for each lamp that is missing.
"""

_QUEUE = '''# Queue module

The module keeps jobs in order of their due time. It has no threads of its own, and every call returns at once.

## Adding jobs

```python
def add(queue, job, due):
    """Adds a job and returns its ticket."""
    ticket = queue.next_ticket
    queue.next_ticket = ticket + 1
    queue.heap.push((due, ticket, job))
    return ticket
```

Two jobs of the same due time run in the order of their tickets. A ticket is never used again, even after its job was cancelled. The due time is a number of whole milliseconds since the queue was made.

## Taking jobs

```python
def take(queue, now):
    """Takes the next job that is due, or None."""
    while queue.heap:
        due, ticket, job = queue.heap.least()
        if due > now:
            return None
        queue.heap.pop()
        if ticket not in queue.cancelled:
            return job
    return None
```

A cancelled job stays in the heap until it would be due. This keeps cancelling cheap, but a queue with many cancelled jobs should be compacted. Call compact after every thousand cancellations and at shutdown.

## Errors

The queue raises LateError when a job is added with a due time in the past. It raises FullError when the heap holds more than the limit of jobs. Neither error changes the queue. A caller that sees FullError should wait for the drain event and try once more.
'''

_CLIENT = """# Client notes

The client retries a request three times with a pause that doubles. The first pause is two hundred milliseconds. A response with the status busy is retried, and a response with the status denied is not.

Set the option trace to true to write every request to the journal. The journal is rotated at midnight and kept for nine days.
"""

_LAKE = """# Lake Orvel

Lake Orvel is a mountain lake in the province of Tarn. It lies at a height of nine hundred metres and is fed by two streams.

## Geography

The lake is four kilometres long and fills a valley that was carved by ice. Its deepest point, at eighty metres, is below the cliffs of the southern shore. Two islands lie near the outlet, of which only the larger one carries trees. The water is clear down to twelve metres in late autumn.

## History

Fishing rights were granted to the abbey of Tarn in the twelfth century. A dam of larch beams raised the lake by a metre in order to float timber to the sawmills. The dam broke during the thaw of 1871 and flooded the lower town. A stone weir has stood in its place since then.

## Wildlife

Char and trout live in the lake, and pike were introduced by anglers. Divers winter on the open water while the bays are frozen. The rare quillwort grows on gravel near the inflow. Otters returned to the northern bay after an absence of sixty years.

## Tourism

A footpath of eleven kilometres leads around the lake and passes three huts. The steamer Amalie carried guests from 1903 until the road was opened. Bathing is allowed at the eastern beach from June to September. Camping within the reserve is forbidden, and wardens patrol the shore on summer nights.
"""

_TOWN = """# Tarn

Tarn is a market town at the outlet of Lake Orvel. The town has a cloth hall, two mills and a school of surveyors.

The cloth hall was built in 1640 and houses the archive of the province. Its tower carries a clock with a single hand. Trains reach the town from the north since the tunnel was finished.
"""

CORPORA = (
    Corpus("pump-manual", "manual", {"pump.md": _PUMP, "gate.md": _GATE}),
    Corpus("field-guide", "documentation", {"marsh.md": _BIRDS, "boardwalk.md": _TRAIL}),
    Corpus("ferry-lease", "legal", {"lease.md": _LEASE, "harbour.md": _RULES}),
    Corpus("queue-code", "code", {"queue.md": _QUEUE, "client.md": _CLIENT}),
    Corpus("lake-wiki", "wiki", {"lake.md": _LAKE, "town.md": _TOWN}),
)

QUESTIONS = (
    Question("pump-grease", "pump-manual", "How much grease does each bearing get when the hour meter advanced by forty hours?", ("two strokes of grease", "grease to each bearing")),
    Question("pump-seal", "pump-manual", "Which seal kit is ordered when the seal weeps?", ("seal kit nineteen",)),
    Question("marsh-rail", "field-guide", "Which bird squeals like a small pig among the reeds?", ("squeals like a small pig",)),
    Question("lease-interest", "ferry-lease", "What interest does late rent bear?", ("three percent above the base rate",)),
    Question("lease-boats", "ferry-lease", "How long may a boat be that is moored at the landing stage overnight?", ("longer than nine metres",)),
    Question("queue-late", "queue-code", "Which error does the queue raise when a job is added with a due time in the past?", ("raises LateError",)),
    Question("lake-dam", "lake-wiki", "When did the dam break and flood the lower town?", ("the thaw of 1871",)),
    Question("lake-otters", "lake-wiki", "Which animals returned to the northern bay after an absence of sixty years?", ("absence of sixty years",)),
)
