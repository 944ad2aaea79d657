"""vellumine.plans"""
