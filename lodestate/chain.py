"""Blocks over snapshots: open a block on any known state, change it, commit, finalize, and read at any state.

A block's changes are rows of an op log. Unfinalized blocks stay rows; finalizing folds them, oldest first, into the
next snapshot. Calls that set single keys gather rows on the driver (a block's own input); whole tables of changes
come in as DataFrames through ``apply``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bits, rlp
from .functions.keccak import EMPTY_TREE
from .functions.paths import ACCOUNT, STORAGE
from .operators import overlay, tries
from .operators.overlay import DESTROY, PERSISTENT, PREFIX_DELETE, SET
from .sources.shared import stored
from .sources.snapshots import SnapshotStore, StateGone

OPS = "block_hash string, seq long, op int, type int, account string, slot string, value binary, entry_type int"
EMPTY = EMPTY_TREE.hex().upper()


def _bytes(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


class View:
    """The state at one hash: (account, type, slot, value)."""

    def __init__(self, state: DataFrame, state_hash: str) -> None:
        self.state, self.hash = state, state_hash

    def accounts(self, keys: DataFrame | None = None) -> DataFrame:
        """(account, balance, nonce, code_hash, storage_root); asked keys (account) that don't exist read as the empty account."""
        rows = self.state.where(F.col("type") == ACCOUNT).select("account", "value")
        if keys is not None:
            rows = keys.select("account").join(rows, "account", "left")
        return rows.select("account", rlp.account_from_bytes(F.col("value")).alias("a")).select("account", "a.*")

    def storage(self, keys: DataFrame | None = None) -> DataFrame:
        """(account, slot, value); asked keys (account, slot) that don't exist read as empty."""
        rows = self.state.where(F.col("type") == STORAGE).select("account", "slot", "value")
        return rows if keys is None else overlay.lookup(rows, keys, ["account", "slot"])

    def get_account(self, account: str) -> tuple[int, int]:
        """(balance, nonce) of one account: literal predicates reach the snapshot's folders and files."""
        row = self.state.where((F.col("account") == account.upper()) & (F.col("type") == ACCOUNT)).select(rlp.account_from_bytes(F.col("value")).alias("a")).first()
        return (int.from_bytes(row.a.balance, "big"), int.from_bytes(row.a.nonce, "big")) if row else (0, 0)

    def get_storage(self, account: str, slot: str) -> bytes:
        row = self.state.where((F.col("account") == account.upper()) & (F.col("slot") == slot.upper()) & (F.col("type") == STORAGE)).select("value").first()
        return bytes(row.value) if row else b""

    def storage_root(self, account: str) -> str:
        """Root hash of one account's storage."""
        row = tries.storage_root(self.storage(), account).first()
        return bytes(row.root).hex().upper() if row else EMPTY

    def subtrie_hash(self, prefix: str, account: str | None = None) -> str:
        """Hash of what lies under a path of the state (its accounts with their stored roots), or of one account's storage."""
        if account is not None:
            row = tries.storage_subtrie_root(self.storage(), account, prefix).first()
        else:
            own = self.accounts()
            row = tries.subtrie_root(tries.account_leaves(own, own.select(F.col("account").alias("trie"), F.col("storage_root").alias("root"))), prefix).first()
        return bytes(row.root).hex().upper() if row else EMPTY

    def root(self) -> str:
        """Root hash of the state, with all storage roots computed anew."""
        self.state = stored(self.state, "state")
        return bytes(tries.state_root(self.accounts().select("account", "balance", "nonce", "code_hash"), self.storage()).first().root).hex().upper()


class Roots:
    """What a state's root is made of: hashed parts of the state's trie and of all storage tries, and the storage roots.

    ``after`` makes those of a later state: only parts that its ops touch are read, folded and hashed again.
    """

    def __init__(self, state: DataFrame, storage: DataFrame, roots: DataFrame, level: int) -> None:
        self.state, self.storage, self.roots, self.level = state, storage, roots, level

    @classmethod
    def of(cls, state: DataFrame, level: int) -> Roots:
        """Those of (account, type, slot, value)."""
        view = View(stored(state, "state"), "")
        storage = tries.reduced_parts(tries.storage_leaves(view.storage()), level)
        roots = tries.roots_of_parts(storage)
        return cls(tries.reduced_parts(tries.account_leaves(view.accounts(), roots), level), storage, roots, level)

    def after(self, base: DataFrame, ops: DataFrame) -> Roots:
        """Those of the fold of ops over base, the state that these are of."""
        ops = stored(ops, "ops")
        head = lambda column: F.substr(F.col(column), F.lit(1), F.lit(self.level))
        sets, deletes = ops.where(F.col("op") == SET), ops.where(F.col("op") == PREFIX_DELETE)
        destroyed = ops.where(F.col("op") == DESTROY).select(F.col("account").alias("trie")).distinct()
        under = F.col("prefix").startswith(F.col("slot")) | F.col("slot").startswith(F.col("prefix"))
        known = self.storage.select("trie", "prefix")
        cut = deletes.where(F.col("type") == STORAGE).select(F.col("account").alias("trie"), "slot")
        touched = sets.where(F.col("type") == STORAGE).select(F.col("account").alias("trie"), head("slot").alias("prefix"))
        touched = stored(touched.union(known.join(destroyed, "trie")).union(known.join(cut, "trie").where(under).select("trie", "prefix")).distinct(), "touched")
        slots = base.where(F.col("type") == STORAGE).withColumns({"trie": F.col("account"), "prefix": head("slot")}).join(touched, ["trie", "prefix"], "left_semi")
        now = overlay.fold(slots, ops.where((F.col("type") == STORAGE) | (F.col("op") == DESTROY)))
        storage = tries.replaced_parts(self.storage, tries.storage_leaves(now.select("account", "slot", "value")), touched, self.level)
        changed = stored(touched.select("trie").distinct(), "tries")
        roots = stored(self.roots.join(changed, "trie", "left_anti").union(tries.roots_of_parts(storage.join(changed, "trie", "left_semi"))), "roots")
        prefixes = self.state.select("prefix").distinct()
        heads = sets.where(F.col("type") == ACCOUNT).select(head("account").alias("prefix")).union(destroyed.union(changed).select(head("trie")))
        heads = heads.union(prefixes.join(deletes.where(F.col("type") == ACCOUNT).select("slot"), under).select("prefix"))
        touched = stored(heads.distinct().select(F.lit("").alias("trie"), "prefix"), "touched")
        rows = base.where(F.col("type") == ACCOUNT).withColumn("prefix", head("account")).join(touched, "prefix", "left_semi")
        accounts = View(overlay.fold(rows, ops.where((F.col("type") == ACCOUNT) | (F.col("op") == DESTROY))), "").accounts()
        return Roots(tries.replaced_parts(self.state, tries.account_leaves(accounts, roots), touched, self.level), storage, roots, self.level)

    def root(self) -> str:
        row = tries.roots_of_parts(self.state).first()
        return bytes(row.root).hex().upper() if row else EMPTY


class Block:
    """An open block. Hooks (callables of the block's ops) run before its hash is computed."""

    def __init__(self, chain: Chain, parent: str, hooks: tuple[Callable[[DataFrame], None], ...] = ()) -> None:
        self.chain, self.parent, self.hooks = chain, parent, hooks
        self._rows: list[tuple] = []
        self._tables: list[DataFrame] = []
        self._seq = 0

    def _add(self, op: int, kind: int, account: str, slot: str = "", value: bytes | None = None, entry_type: int = PERSISTENT) -> None:
        self._seq += 1
        self._rows.append(("", self._seq, op, kind, account.upper(), slot.upper(), value, entry_type))

    def set_account(self, account: str, balance: int, nonce: int) -> None:
        b, n = _bytes(balance), _bytes(nonce)
        row = bytes([0x80 | len(n) << 4 | len(b)]) + b + n if len(b) <= 15 and len(n) <= 3 else None
        if row is None:
            from .functions.keccak import EMPTY_CODE

            row = bytes([len(b), len(n)]) + b + n + EMPTY_CODE + EMPTY_TREE
        self._add(SET, ACCOUNT, account, value=row)

    def set_storage(self, account: str, slot: str, value: bytes) -> None:
        self._add(SET, STORAGE, account, slot, value)

    def destroy_account(self, account: str) -> None:
        self._add(DESTROY, ACCOUNT, account)

    def delete_by_prefix(self, prefix: str, account: str | None = None) -> None:
        """Accounts under a path, or one account's slots; applied to what the block starts from, before its sets."""
        self._add(PREFIX_DELETE, STORAGE if account is not None else ACCOUNT, account or "", prefix)

    def apply(self, ops: DataFrame) -> None:
        """Changes from a table of ops (their seq orders them among themselves; they follow the rows set so far)."""
        self._tables.append(ops.select(F.lit("").alias("block_hash"), (F.col("seq") + self._seq).alias("seq"), "op", "type", "account", "slot", "value", "entry_type"))
        self._seq += 1 << 40

    def setter(self, account: str) -> Callable[[str, bytes], None]:
        """A function that sets slots of one account."""
        return lambda slot, value: self.set_storage(account, slot, value)

    def describe(self, predicate: Column | None = None) -> DataFrame:
        """The keys that the block changes, of those a predicate over (type, account, slot, value, entry_type) admits."""
        return overlay.describe(self.ops(), predicate)

    def visit(self, kind: int) -> DataFrame:
        """The changes of one type of keys: what a hook before the commit may ask for."""
        return overlay.visit(self.ops(), kind)

    def reset(self) -> None:
        self._rows, self._tables, self._seq = [], [], 0

    def ops(self) -> DataFrame:
        out = self.chain.spark.createDataFrame(self._rows, OPS)
        for table in self._tables:
            out = out.unionByName(table)
        return out

    def view(self) -> View:
        """What this block sees now."""
        base = self.chain.view(self.parent).state
        return View(overlay.fold(base, self.ops()), "")

    def touched(self) -> DataFrame:
        return overlay.touched(self.ops().where(F.col("type") == STORAGE))

    def commit(self, number: int, state_hash: str | None = None) -> str:
        """Publish under the state's root hash, or under a given name (blocks that are synced raw, without a root).

        A block that changes nothing publishes nothing; a repeated one counts once.
        """
        for hook in self.hooks:
            hook(self.ops())
        if state_hash is None:
            roots = self._roots()
            state_hash = roots.root()
            self.chain.roots[state_hash] = roots
        if state_hash != self.parent:
            self.chain._publish(state_hash, self.parent, number, self.ops())
        return state_hash

    def _roots(self) -> Roots:
        """From the parent's, if these are known: of other parents, everything is hashed."""
        base, known = self.chain.view(self.parent).state, self.chain.roots.get(self.parent)
        return known.after(base, self.ops()) if known else Roots.of(overlay.fold(base, self.ops()), self.chain.level)


class Raw(Block):
    """A state under synchronisation: nodes may be known by hashes alone, and commits need no root.

    ``nodes`` are the trie nodes put in so far: (account, path, kind, node_path, children, memo, ref, persist).
    """

    def __init__(self, chain: Chain, parent: str) -> None:
        super().__init__(chain, parent)
        self.nodes = tries.synced_leaves(chain.spark.createDataFrame([], "account string, path string, node_path string"))
        self.hash = parent

    def create_branch(self, account: str, path: str, children: dict[str, bytes], persist: bool = True) -> None:
        rows = self.chain.spark.createDataFrame([(account, path, [{"nibble": k, "hash": v} for k, v in children.items()], persist)], "account string, path string, children array<struct<nibble:string,hash:binary>>, persist boolean")
        self.nodes = self.nodes.unionByName(tries.synced_branches(rows))

    def create_extension(self, account: str, path: str, node_path: str, child: bytes, persist: bool = True) -> None:
        rows = self.chain.spark.createDataFrame([(account, path, node_path, child, persist)], "account string, path string, node_path string, child binary, persist boolean")
        self.nodes = self.nodes.unionByName(tries.synced_extensions(rows))

    def create_leaf(self, account: str, path: str, node_path: str) -> None:
        self.nodes = self.nodes.unionByName(tries.synced_leaves(self.chain.spark.createDataFrame([(account, path, node_path)], "account string, path string, node_path string")))

    def is_persisted(self, account: str, path: str, hash_: bytes | None = None) -> bool:
        keys = self.chain.spark.createDataFrame([(account, path, hash_)], "account string, path string, hash binary")
        return tries.persisted(keys, self.nodes).first().persisted

    def process_proofs(self, account: str = "") -> list[str]:
        """Paths of the account's proof branches that now have all their children, and so persist from here on."""
        own = self.nodes.where(F.col("account") == account)
        kids = F.transform(F.map_entries("memo"), lambda e: F.struct(F.hex(e["key"].cast("long")).alias("nibble"), e["value"].alias("hash")))
        proofs = own.where("not persist and kind = 'branch'").select("path", F.col("ref").alias("hash"), kids.alias("children"))
        done = [r.path for r in tries.promote_proofs(proofs, own.where("persist").select("path", F.col("ref").alias("hash"))).collect()]
        self.nodes = self.nodes.withColumn("persist", F.col("persist") | ((F.col("account") == account) & F.col("path").isin(done)))
        return done

    def commit(self, number: int = 0, state_hash: str | None = None, ensure_hash: bool = True, keep_open: bool = False) -> str:
        """Make the changes part of the raw state. Without ensure_hash no root is computed; keep_open lets more changes follow."""
        if ensure_hash and state_hash is None:
            self.hash = self.view().root()
        else:
            self.hash = state_hash or self.hash
        self._open = keep_open
        return self.hash

    def seal(self, number: int, state_hash: str | None = None) -> str:
        """Write the state as a version, with its root (or a given name) and block number."""
        self.hash = state_hash or self.view().root()
        self.chain.store.commit(self.view().state, number, self.hash)
        self.chain.finalized = self.hash, number
        return self.hash


class Accessor:
    """Reads at any known state by its hash; an unknown hash reads as an empty state.

    Known are the store's retained versions and the blocks above them: as blocks become versions, forks go and old
    versions leave the history, the accessor follows. Asked hashes are few; keys are a table.
    """

    def __init__(self, chain: Chain) -> None:
        self.chain = chain

    def hashes(self) -> list[str]:
        return [*self.chain.blocks, *(r.state_hash for r in self.chain.store._rows())]

    def has_state(self, state_hash: str) -> bool:
        return state_hash in self.hashes()

    def view(self, state_hash: str) -> View:
        if not self.has_state(state_hash):
            return View(self.chain.spark.createDataFrame([], "account string, slot string, type int, value binary"), state_hash)
        return self.chain.view(state_hash)

    def get_account(self, state_hash: str, account: str) -> tuple[int, int]:
        return self.view(state_hash).get_account(account)

    def get_storage(self, state_hash: str, account: str, slot: str) -> bytes:
        return self.view(state_hash).get_storage(account, slot)

    def _read(self, keys: DataFrame, on: list[str], rows: Callable[[View], DataFrame]) -> DataFrame:
        """keys left-joined, by state hash and on, with the rows of the states they ask for."""
        known = set(self.hashes())
        asked = [r[0] for r in keys.select("state_hash").distinct().where(F.col("state_hash").isin(*known)).collect()] if known else []
        if not asked:
            return keys.withColumn("value", F.lit(None).cast("binary"))
        every = reduce(DataFrame.unionByName, [rows(self.chain.view(h)).withColumn("state_hash", F.lit(h)) for h in asked])
        return keys.join(every, ["state_hash", *on], "left")

    def accounts(self, keys: DataFrame) -> DataFrame:
        """keys (state_hash, account) with balance, nonce, code_hash and storage_root; unknown ones read as the empty account."""
        met = self._read(keys, ["account"], lambda v: v.state.where(F.col("type") == ACCOUNT).select("account", "value"))
        return met.select(*keys.columns, rlp.account_from_bytes(F.col("value")).alias("a")).select(*keys.columns, "a.*")

    def storage(self, keys: DataFrame) -> DataFrame:
        """keys (state_hash, account, slot) with their value; unknown ones read as empty."""
        met = self._read(keys, ["account", "slot"], lambda v: v.state.where(F.col("type") == STORAGE).select("account", "slot", "value"))
        return met.withColumn("value", F.coalesce("value", F.lit(b"")))


class Chain:
    """Fork-aware blocks above a snapshot store. finality: blocks below the head by that much finalize by themselves.

    level: nibbles by which tries are hashed in parts; a part of the largest trie should have some ten thousand keys.
    """

    def __init__(self, store: SnapshotStore, finality: int | None = None, level: int = tries.STEP) -> None:
        self.level, self.roots = level, {}
        self.store, self.spark, self.finality = store, store.spark, finality
        self.blocks: dict[str, tuple[str, int, DataFrame]] = {}
        last = store.latest()
        self.finalized: tuple[str, int] = (last.state_hash, last.block_number) if last else (EMPTY, 0)

    def start(self, parent: str = EMPTY, *hooks: Callable[[DataFrame], None]) -> Block:
        if not self.has_state(parent):
            raise StateGone(parent)
        return Block(self, parent, hooks)

    def start_raw(self, parent: str | None = None) -> Raw:
        """A raw state on the last version."""
        return Raw(self, self.finalized[0] if parent is None else parent)

    def accessor(self) -> Accessor:
        return Accessor(self)

    def import_blocks(self, ops: DataFrame, per_block: int, lag: int = 4, name: str = "import") -> int:
        """Bulk load: ops in the order of seq, per_block of them a block; all but the last ``lag`` blocks are finalized.

        What gets final is one fold, however many blocks it is; returns the number of blocks. seq counts from 0 without gaps.
        """
        placed = stored(ops.withColumn("number", (F.floor(F.col("seq") / per_block) + 1).cast("long")).withColumn("block_hash", F.concat(F.lit(f"{name}-"), "number")), "import")
        top = placed.agg(F.max("number")).first()[0] or 0
        final, first = max(0, top - lag), self.finalized[1]
        if final:
            base = self.store.read_head().select("account", "slot", "type", "value")
            self.store.commit(overlay.fold(base, placed.where(F.col("number") <= final)), first + final, f"{name}-{final}")
            self.finalized = f"{name}-{final}", first + final
        for n in range(final + 1, top + 1):
            self._publish(f"{name}-{n}", f"{name}-{n - 1}" if n > 1 else self.finalized[0], first + n, placed.where(F.col("number") == n).select([x.split()[0] for x in OPS.split(", ")]))
        return top

    def has_state(self, state_hash: str) -> bool:
        return state_hash == EMPTY or state_hash in self.blocks or self.store.has_state(state_hash)

    def _publish(self, state_hash: str, parent: str, number: int, ops: DataFrame) -> None:
        if state_hash in self.blocks and self.blocks[state_hash][1] == number:
            return
        self.blocks[state_hash] = parent, number, ops.withColumn("block_hash", F.lit(state_hash))
        if self.finality is not None and number - self.finalized[1] > self.finality:
            path = [h for h, _ in self.ancestors(state_hash)]
            self.finalize(path[min(self.finality, len(path) - 1)])

    def ancestors(self, state_hash: str) -> list[tuple[str, int]]:
        """(hash, number) of the unfinalized blocks from a hash down to the store's state."""
        out = []
        while state_hash in self.blocks:
            parent, number, _ = self.blocks[state_hash]
            out.append((state_hash, number))
            state_hash = parent
        if state_hash != EMPTY and not self.store.has_state(state_hash):
            raise StateGone(state_hash)
        return out

    def view(self, state_hash: str) -> View:
        """The state at a hash: a snapshot with the blocks above it folded over."""
        path = self.ancestors(state_hash)
        root = self.blocks[path[-1][0]][0] if path else state_hash
        state = self.store.read(root) if root != EMPTY else self.spark.createDataFrame([], "account string, slot string, type int, value binary")
        return View(self._folded(state, path), state_hash)

    def _folded(self, state: DataFrame, path: list[tuple[str, int]]) -> DataFrame:
        """The state with the blocks of a path over it, all in one fold."""
        state = state.select("account", "slot", "type", "value")
        if not path:
            return state
        parts = [self.blocks[block][2].withColumn("number", F.lit(number).cast("long")) for block, number in path]
        return overlay.fold(state, reduce(DataFrame.unionByName, parts))

    def latest(self) -> View:
        return View(self.store.read_latest().select("account", "slot", "type", "value"), self.finalized[0])

    def finalize(self, state_hash: str) -> bool:
        """Fold the block and those below it into snapshots, oldest first. At or below the last finalized: nothing to do.

        Blocks that the store's history wouldn't keep have no version of their own: they are folded together with the next.
        """
        if state_hash not in self.blocks:
            if state_hash == self.finalized[0] or self.store.has_state(state_hash):
                return True
            raise StateGone(state_hash)
        if self.blocks[state_hash][1] <= self.finalized[1]:
            return True
        path = list(reversed(self.ancestors(state_hash)))  # oldest first
        versions = [path[: max(1, len(path) - self.store.history + 1)], *([x] for x in path[max(1, len(path) - self.store.history + 1) :])]
        for part in versions:
            block, number = part[-1]
            parent = self.blocks[part[0][0]][0]
            base = self.store.read(parent) if parent != EMPTY else self.spark.createDataFrame([], "account string, slot string, type int, value binary")
            self.store.commit(self._folded(base, part), number, block)
            self.finalized = block, number
            self.blocks = {h: b for h, b in self.blocks.items() if b[1] > number}  # forks of the same height go as well
        kept = {*self.blocks, *(r.state_hash for r in self.store._rows())}
        self.roots = {h: r for h, r in self.roots.items() if h in kept}
        return True
