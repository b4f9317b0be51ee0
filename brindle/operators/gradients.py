"""Reverse-mode gradients of NumPy expressions, as far as the joint model needs them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


class Var:
    """An array and, where a gradient is wanted, how it came from others."""

    __array_ufunc__ = None  # arrays leave arithmetic with a Var to it

    def __init__(self, value: np.ndarray, parents: Sequence[tuple[Var, Callable[[np.ndarray], np.ndarray]]] = (), wanted: bool = False):
        self.value = np.asarray(value, float)
        self.parents = [(p, back) for p, back in parents if p.wanted]
        self.wanted = wanted or bool(self.parents)
        self.grad: np.ndarray | None = None

    def __add__(self, other: Var | np.ndarray | float) -> Var:
        a, b = self, var(other)
        return Var(a.value + b.value, [(a, lambda g: _shrink(g, a)), (b, lambda g: _shrink(g, b))])

    def __mul__(self, other: Var | np.ndarray | float) -> Var:
        a, b = self, var(other)
        return Var(a.value * b.value, [(a, lambda g: _shrink(g * b.value, a)), (b, lambda g: _shrink(g * a.value, b))])

    __radd__, __rmul__ = __add__, __mul__

    def __sub__(self, other: Var | np.ndarray | float) -> Var:
        return self + var(other) * -1.0

    def __getitem__(self, key) -> Var:
        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(self.value)
            np.add.at(out, key, g)
            return out

        return Var(self.value[key], [(self, back)])

    def backward(self) -> None:
        """Adds the gradient of this (scalar) value to every variable it came from."""
        order: list[Var] = []
        seen: set[int] = set()
        stack: list[tuple[Var, bool]] = [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack.extend((p, False) for p, _ in node.parents)
        self.grad = np.ones_like(self.value)
        for node in reversed(order):
            for parent, back in node.parents:
                share = back(node.grad)
                parent.grad = share if parent.grad is None else parent.grad + share


def var(x: Var | np.ndarray | float) -> Var:
    return x if isinstance(x, Var) else Var(x)


def _shrink(g: np.ndarray, to: Var) -> np.ndarray:
    """A gradient summed over the axes that broadcasting added."""
    g = g.sum(axis=tuple(range(g.ndim - to.value.ndim)))
    wide = tuple(k for k, n in enumerate(to.value.shape) if n == 1 and g.shape[k] != 1)
    return g.sum(axis=wide, keepdims=True) if wide else g


def product(spec: str, a: Var | np.ndarray, b: Var | np.ndarray) -> Var:
    """``einsum`` of two arrays; every index of one is in the other or in the result."""
    a, b = var(a), var(b)
    left, right, out = spec.replace("->", ",").split(",")
    return Var(
        np.einsum(spec, a.value, b.value, optimize=True),
        [
            (a, lambda g: np.einsum(f"{out},{right}->{left}", g, b.value, optimize=True)),
            (b, lambda g: np.einsum(f"{out},{left}->{right}", g, a.value, optimize=True)),
        ],
    )


def _pointwise(x: Var, value: np.ndarray, slope: Callable[[], np.ndarray]) -> Var:
    return Var(value, [(x, lambda g: g * slope())])


def exp(x: Var) -> Var:
    y = np.exp(x.value)
    return _pointwise(x, y, lambda: y)


def log(x: Var) -> Var:
    return _pointwise(x, np.log(x.value), lambda: 1.0 / x.value)


def tanh(x: Var) -> Var:
    y = np.tanh(x.value)
    return _pointwise(x, y, lambda: 1.0 - y * y)


def relu(x: Var) -> Var:
    return _pointwise(x, np.maximum(x.value, 0.0), lambda: x.value > 0)


def root(x: Var) -> Var:
    y = np.sqrt(x.value)
    return _pointwise(x, y, lambda: 0.5 / y)


def total(x: Var, axis: int | tuple[int, ...] | None = None) -> Var:
    def back(g: np.ndarray) -> np.ndarray:
        return np.broadcast_to(g if axis is None else np.expand_dims(g, axis), x.value.shape)

    return Var(x.value.sum(axis=axis), [(x, back)])


def largest(x: Var, axis: int) -> Var:
    """Maximum over an axis; the first of equals has the gradient."""
    at = np.expand_dims(x.value.argmax(axis=axis), axis)

    def back(g: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x.value)
        np.put_along_axis(out, at, np.expand_dims(g, axis), axis)
        return out

    return Var(np.take_along_axis(x.value, at, axis).squeeze(axis), [(x, back)])


def softmax(x: Var, axis: int) -> Var:
    e = np.exp(x.value - x.value.max(axis=axis, keepdims=True))
    y = e / e.sum(axis=axis, keepdims=True)
    return Var(y, [(x, lambda g: y * (g - (g * y).sum(axis=axis, keepdims=True)))])


def swap(x: Var, *order: int) -> Var:
    return Var(x.value.transpose(order), [(x, lambda g: g.transpose(np.argsort(order)))])


def joined(parts: Sequence[Var | np.ndarray], axis: int = 0) -> Var:
    own = [var(p) for p in parts]
    ends = np.cumsum([p.value.shape[axis] for p in own])

    def back(k: int) -> Callable[[np.ndarray], np.ndarray]:
        return lambda g: np.take(g, np.arange(ends[k] - own[k].value.shape[axis], ends[k]), axis=axis)

    return Var(np.concatenate([p.value for p in own], axis=axis), [(p, back(k)) for k, p in enumerate(own)])
