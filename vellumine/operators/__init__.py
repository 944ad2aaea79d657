"""vellumine.operators"""
