import numpy as np

from gristdex.llm.textforms import TermHasher
from gristdex.llm.toxicity import Bags, FactorizationMachine


def test_terms_in_two_documents_are_learned_at_any_size():
    h = TermHasher()
    for n in (500, 3200):
        texts = [f"the gate {i % 50} came loose" if i % 4 else f"you are scum {i % 50}" for i in range(n)]
        texts[4], texts[8] = "zugwort here", "zugwort there"
        texts[12] = "you einmal"
        y = np.array([float(i % 4 == 0) for i in range(n)])
        fm = FactorizationMachine(h.size).fit(Bags.of(h.batch(texts)), y, rounds=2)
        own, once = h.terms("zugwort"), h.terms("einmal")
        assert (fm.w[own] > 0).all() and fm.v[own].any() and not fm.w[once].any() and not fm.v[once].any()
